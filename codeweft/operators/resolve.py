"""Joins that resolve references: by priority, by interval, by nearest row, by route template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import parent_folder, route_key


def resolve_calls(sites: DataFrame, registry: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (site, target, strategy): what a called name refers to.

    sites: site, file_path, callee. registry: qualified_name, name, file_path. imports: file_path, imported.
    The first tier that decides wins: all in the same file; one among the imported files, or all if they are in one of them;
    exactly one in the same folder (not the root); exactly one anywhere. Otherwise the call is left open.

    A name called in a file is decided once, against counts of the registry by name, by folder and by file, so a common name
    never meets all its definitions; they are listed only where a file's definitions are the answer.
    """
    r = registry.select(F.col("qualified_name").alias("target"), F.col("name").alias("callee"), F.col("file_path").alias("home"))
    one = lambda *keys: r.withColumn("folder", parent_folder(F.col("home"))).groupBy("callee", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("only"))
    asked = sites.select("file_path", "callee").distinct().withColumn("folder", parent_folder(F.col("file_path")))
    here = one("home").select("callee", F.col("home").alias("file_path"), F.col("n").alias("n1"))
    brought = imports.select("file_path", F.col("imported").alias("home")).distinct()
    met = asked.select("file_path", "callee").join(brought, "file_path").join(one("home"), ["callee", "home"])
    through = met.groupBy("file_path", "callee").agg(F.sum("n").alias("n2"), F.count(F.lit(1)).alias("f2"), F.min("home").alias("home2"))
    near = one("folder").where("folder <> '' and n = 1").select("callee", "folder", F.col("only").alias("t3"))
    alone = one().where("n = 1").select("callee", F.col("only").alias("t4"))
    told = asked.join(here, ["file_path", "callee"], "left").join(through, ["file_path", "callee"], "left").join(near, ["callee", "folder"], "left").join(alone, "callee", "left")
    tier = F.when(F.col("n1") > 0, "same_file").when((F.col("n2") == 1) | (F.col("f2") == 1), "import_map").when(F.col("t3").isNotNull(), "same_directory").when(F.col("t4").isNotNull(), "unique_name")
    told = told.withColumn("strategy", tier).where("strategy is not null")
    where = F.when(F.col("strategy") == "same_file", F.col("file_path")).when(F.col("strategy") == "import_map", F.col("home2"))
    single = told.where("strategy in ('same_directory', 'unique_name')").select("file_path", "callee", "strategy", F.when(F.col("strategy") == "same_directory", F.col("t3")).otherwise(F.col("t4")).alias("target"))
    listed = told.where("strategy in ('same_file', 'import_map')").withColumn("home", where).join(r, ["callee", "home"]).select("file_path", "callee", "strategy", "target")
    return sites.join(single.unionByName(listed), ["file_path", "callee"]).select("site", "target", "strategy")


def resolve_parents(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (ref, target, strategy): the class a base name refers to.

    refs: ref, file_path, base. registry: qualified_name, name, label, file_path. In the same file (a Class before others,
    then by name); the only one anywhere; the first Class anywhere; else a stand-in at line 0 of the same file.

    A base named in a file is decided once, against one row for each name and one for each name in a file: references never meet
    all definitions of a common name.
    """
    r = registry.select(F.col("name").alias("base"), "qualified_name", (F.col("label") != "Class").alias("other"), F.col("file_path"))
    asked = refs.select("file_path", "base").distinct()
    local = r.groupBy("base", "file_path").agg(F.min(F.struct("other", "qualified_name"))["qualified_name"].alias("t1"))
    known = r.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("t2"), F.min(F.when(~F.col("other"), F.col("qualified_name"))).alias("t3"))
    told = asked.join(local, ["base", "file_path"], "left").join(known, "base", "left")
    name = F.when(F.col("t1").isNotNull(), "local").when(F.col("n") == 1, "unique").when(F.col("t3").isNotNull(), "first_class").otherwise("synthetic")
    made = F.concat("file_path", F.lit("::Class::"), "base", F.lit("@L0"))
    told = told.select("file_path", "base", F.coalesce("t1", F.when(F.col("n") == 1, F.col("t2")), "t3", made).alias("target"), name.alias("strategy"))
    return refs.select("ref", "file_path", "base").distinct().join(told, ["file_path", "base"]).select("ref", "target", "strategy")


def _canonical(spans: DataFrame) -> DataFrame:
    """Add level and node: each span as the fewest aligned ranges of 2^level lines, at most two of a level, which together are
    its lines. A line lies in one range of each level, so a span covers a point if they share exactly one (level, node)."""
    end = F.col("high") + 1

    def nodes(k: Column) -> Column:
        left = -_shift(-F.col("low"), k)
        right = _shift(end, k)
        inside = left < right
        return F.array(
            F.when(inside & (F.pmod(left, F.lit(2)) == 1), F.struct(k.alias("level"), left.alias("node"))),
            F.when(inside & (F.pmod(right, F.lit(2)) == 1), F.struct(k.alias("level"), (right - 1).alias("node"))),
        )

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("high") - F.col("low") + 2)).cast("int"))
    parts = F.filter(F.flatten(F.transform(levels, nodes)), lambda x: x.isNotNull())
    return spans.where("low <= high").withColumn("__at", F.explode(parts)).select(*spans.columns, "__at.level", "__at.node")


def _shift(x: Column, k: Column) -> Column:
    """Floor of x over 2^k."""
    return F.call_function("shiftright", x, k)


def _ranges_of(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points with the aligned ranges that their lines lie in, of the levels that their file's spans have."""
    most = spans.groupBy("file_path").agg(F.max("level").alias("most"))
    levels = F.explode(F.sequence(F.lit(0), F.col("most")))
    return points.join(most, "file_path").withColumn("level", levels).withColumn("node", _shift(F.col("line"), F.col("level"))).drop("most", "line")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span of the same file that covers a point. points: point, file_path, line. spans: span, file_path, low, high (whole numbers).

    An equi-join on aligned ranges of lines, which meets just the pairs that it returns.
    """
    cut_up = _canonical(spans.select("span", "file_path", "low", "high"))
    return _ranges_of(points.select("point", "file_path", "line"), cut_up).join(cut_up, ["file_path", "level", "node"]).select("point", "span")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The covering span that starts last, ties to the larger name.

    Of the spans that share an aligned range of lines only that which starts last is kept, so deep nests cost no more than flat ones.
    """
    last = _canonical(spans.select("span", "file_path", "low", "high")).groupBy("file_path", "level", "node").agg(F.max(F.struct("low", "span")).alias("last"))
    met = _ranges_of(points.select("point", "file_path", "line"), last).join(last, ["file_path", "level", "node"])
    return met.groupBy("point").agg(F.max("last")["span"].alias("span"))


#: Lines that are looked through for the next start together.
STRETCH = 4_096


def next_after(points: DataFrame, starts: DataFrame, tolerance: int | None = None, inclusive: bool = False) -> DataFrame:
    """As-of join forward: the first start after the point (at most `tolerance` later), ties to the smaller name.

    points: point, file_path, line. starts: start, file_path, low (whole numbers). Points and starts of a stretch of lines are
    sorted together, and the start met last on the way back is the answer; where the stretch has none, it is the first start of the
    next stretch that has one. So no file is sorted in one task, and no point meets more than one start.
    """
    stretch = lambda line: F.floor(F.col(line) / STRETCH).cast("long").alias("stretch")
    asked = points.select("point", "file_path", "line", stretch("line"), F.lit(None).cast(starts.schema["start"].dataType).alias("start"))
    known = starts.where("low is not null").select(F.lit(None).cast(points.schema["point"].dataType).alias("point"), "file_path", F.col("low").alias("line"), stretch("low"), "start")
    # Backwards; on one line a point comes before the starts if those don't count for it, and a smaller name after larger ones.
    is_start = F.col("start").isNotNull()
    back = Window.partitionBy("file_path", "stretch").orderBy(F.desc("line"), F.desc(is_start) if inclusive else F.asc(is_start), F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    near = asked.unionByName(known).withColumn("met", F.last(F.when(is_start, F.struct(F.col("line").alias("low"), "start")), True).over(back)).where(~is_start)
    heads = known.groupBy("file_path", "stretch").agg(F.min(F.struct(F.col("line").alias("low"), "start")).alias("head"))
    later = Window.partitionBy("file_path").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each stretch that has points or starts.
    places = near.select("file_path", "stretch").distinct().join(heads, ["file_path", "stretch"], "full")
    beyond = places.withColumn("next", F.last("head", True).over(later)).select("file_path", "stretch", "next")
    found = near.join(beyond, ["file_path", "stretch"], "left").select("point", "line", F.coalesce("met", "next").alias("m")).where("m is not null")
    return (found if tolerance is None else found.where(F.col("m.low") <= F.col("line") + tolerance)).select("point", F.col("m.start").alias("start"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def _tails(path: Column) -> Column:
    """All ends of a path that begin with a slash."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/")))


def link_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows (call, route, confidence). calls: call, path. routes: route, template, position (numbers or names that order them).

    An exact route wins, the first of them; else the last template that fits segment by segment (:id, {id} and <id> fit
    anything); else the first of which one path ends in the other, or that has the same last segment if that is of letters, digits,
    - and _ only. Each is an equi-join: on the path; on the path with a star wherever the template has a hole, for each distinct
    set of holes among templates of so many segments; on the ends of either path; on the last segment.
    """
    c = calls.select("call", route_key(F.col("path")).alias("p")).withColumn("ps", _segments(F.col("p")))
    r = routes.select("route", "position", route_key(F.col("template")).alias("t")).withColumn("ts", _segments(F.col("t")))
    order = F.struct("position", "route")
    whole = r.groupBy("t").agg(F.min(order).alias("m"))
    exact = c.join(whole, F.col("p") == F.col("t")).select("call", F.lit(1).alias("class"), "m")
    holes = F.transform("ts", lambda x: x.rlike(r"^(:|<|\{.*\}$)"))
    shaped = r.withColumn("holes", holes).withColumn("key", _starred(F.col("ts"), F.col("holes")))
    # One row for each key: what fits a call is the last template of all keys that it matches.
    templates = shaped.groupBy("holes", "key").agg(F.max(order).alias("m"))
    shapes = shaped.select(F.size("ts").alias("n"), "holes").distinct()
    masked = c.withColumn("n", F.size("ps")).join(shapes, "n").withColumn("key", _starred(F.col("ps"), F.col("holes")))
    template = masked.join(templates, ["holes", "key"]).groupBy("call").agg(F.max("m").alias("m")).select("call", F.lit(2).alias("class"), "m")
    inside = r.withColumn("tail", F.explode(_tails(F.col("t")))).groupBy("tail").agg(F.min(order).alias("m"))
    around = c.select("call", F.explode(_tails(F.col("p"))).alias("tail")).join(whole, F.col("tail") == F.col("t"))
    last = lambda a: F.when(F.get(a, F.size(a) - 1).rlike("^[A-Za-z0-9_-]+$"), F.get(a, F.size(a) - 1))
    ends = r.groupBy(last(F.col("ts")).alias("last")).agg(F.min(order).alias("m"))
    suffix = c.join(inside, F.col("p") == F.col("tail")).select("call", "m").unionByName(around.select("call", "m")).unionByName(c.withColumn("last", last(F.col("ps"))).join(ends, "last").select("call", "m"))
    suffix = suffix.groupBy("call").agg(F.min("m").alias("m")).select("call", F.lit(3).alias("class"), "m")
    best = exact.unionByName(template).unionByName(suffix).groupBy("call").agg(F.min(F.struct("class", "m.route")).alias("m"))
    name = F.when(F.col("m.class") == 1, "exact").when(F.col("m.class") == 2, "template").otherwise("suffix")
    return best.select("call", F.col("m.route").alias("route"), name.alias("confidence"))


def _starred(segments: Column, holes: Column) -> Column:
    return F.array_join(F.zip_with(segments, holes, lambda x, h: F.when(h, F.lit("*")).otherwise(x)), "/")


def merge_changes(old: DataFrame, changed: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """Rows of `old` but those of changed or removed keys, and the rows of `changed`."""
    stay = old.join(changed.select(key), key, "left_anti")
    stay = stay if removed is None else stay.join(removed.select(key), key, "left_anti")
    return stay.unionByName(changed)
