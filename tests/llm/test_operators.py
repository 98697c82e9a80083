"""Each operator against a plain Python version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables,
columns with clashing names."""

import collections
import hashlib
import html
import html.parser
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import chat, decontamination, near_duplicates, neighbours, packing, quality, sharding, token_counts, toxicity
from codeweft.llm.common import word_hashes
from codeweft.llm.html_text import main_text, page_texts
from codeweft.llm.queries import tokenizer

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **extra):
    rows = [(i if i % 13 else None, t, ["en", None, "fr"][i % 3], ["a", "a", "b", None][i % 4], 0) for i, t in enumerate(texts, 1)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return rows, df


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéö") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 30, 300]))) for _ in range(n)]
    return [*made, None, "", " ", "\n", "...", "A", "<|endoftext|> x", "x" * 5000, " ".join(made), made[5], made[5]]


def test_word_hashes_are_those_of_the_words():
    t = [x or "" for x in texts()]
    hashes, counts = word_hashes(t)
    words = [WORD.findall(x.lower()) for x in t]
    assert counts.tolist() == [len(w) for w in words]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip((w for ws in words for w in ws), hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_token_counts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows, df = documents(spark, [*texts(), "a \n", "  a  b▁▁c ", "<s></s>\t😀"], n_tokens="clash")
    got = token_counts.document_token_counts(df, tokenizer("piece_bpe_32k.model")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t, *_ in rows), key=key)
    assert token_counts.count_tokens(df.limit(0), tokenizer("piece_bpe_32k.model")).count() == 0
    model = tokenizer("piece_bpe_32k.model")
    table = {r["word"]: (r["freq"], r["tokens"]) for r in token_counts.pre_token_table(df, model).collect()}
    seen = collections.Counter(w for r in rows for w in token_counts.pre_tokens(r[1] or "") if len(w.encode()) <= token_counts.LONGEST)
    assert table == {w: (n, len(lib.encode(w))) for w, n in seen.items() if n > 1} and max(map(len, table)) < 5000
    few = {r["word"]: r["freq"] for r in token_counts.pre_token_table(df, model, most=60).collect()}
    assert 20 < len(few) <= 60 and min(few.values()) > max((n for w, n in seen.items() if w not in few and n < 64), default=0)
    # Whatever is in the table and whatever is counted where it stands, the counts are the same.
    for head in (0, 3, 60):
        counted = token_counts.count_tokens(df, model, head=head)
        assert counted.columns == df.columns and sorted((str(r["text"]), r["n_tokens"]) for r in counted.collect()) == sorted((str(t), len(lib.encode(t or ""))) for _, t, *_ in rows)
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    by_text = token_counts.count_tokens(df, tokenizer("word_bpe_49k.json"), out="n", keep=["text"]).collect()
    assert sorted((str(r["text"]), r["n"]) for r in by_text) == sorted((str(t), len(words.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in rows)


def test_packing(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows, df = documents(spark, texts(2), piece="clash")
    got = packing.pack_documents(df, tokenizer("word_bpe_49k.json"), capacity=64).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(df.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_is_no_worse_than_best_fit_and_reaches_the_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 10) for _ in range(9)]
    plan = packing.complete_bins(dict(collections.Counter(sizes)), 10)
    assert sorted(x for n, items in plan for x in items * n) == sorted(sizes) and all(sum(items) <= 10 for _, items in plan)

    def fits(left, bins):
        if not left:
            return True
        tried = set()
        for k, room in enumerate(bins):
            if room >= left[0] and room not in tried:
                tried.add(room)
                if fits(left[1:], [*bins[:k], room - left[0], *bins[k + 1 :]]):
                    return True
        return False

    best = next(n for n in range(1, 10) if fits(sorted(sizes, reverse=True), [10] * n))
    assert sum(n for n, _ in plan) == best


def test_ids_are_those_of_the_library_whatever_the_table_holds(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = tokenizer("word_bpe_49k.json"), random.Random(12)
    lib, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    monkeypatch.setattr(packing, "TABLE_SIZE", 20)
    monkeypatch.setattr(packing, "CHUNK", 60)
    letters = [chr(i) for i in [*range(0x20, 0x7F), 9, 10, 13, *range(0xA1, 0x250), *range(0x2010, 0x2030), 0x3B1, 0x4E00, 0x1F600]]
    made = ["".join(rng.choice(letters) if rng.random() < 0.2 else rng.choice("abc ABC é.,'!") for _ in range(rng.choice([0, 5, 50, 500]))) for _ in range(400)]
    made += ["x" * 300 + " a", " ", "", "a  b\r\nc", "<|endoftext|> a", "don't DON'T 12.5", "word. word word, word.", *made[:20]]
    assert encoder.encode(made) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in made]


@pytest.mark.parametrize("seed", range(5))
def test_fillings_are_the_undominated_sets(seed):
    rng, capacity = random.Random(seed), 20
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x in rng.sample(range(2, 12), 5):
        left[x] = rng.randint(1, 3)
    room, slack = 17, rng.randint(0, 4)
    bags = {()}
    for x in np.flatnonzero(left).tolist():
        bags |= {b + (x,) * m for b in bags for m in range(1, int(left[x]) + 1) if sum(b) + x * m <= room}

    def dominated(b):
        waste, spare = room - sum(b), [x for x in range(1, room + 1) if left[x] > b.count(x)]
        return any(x <= waste or any(y < x <= y + waste for y in b) for x in spare)

    want = {b for b in bags if room - sum(b) <= slack and (sum(b) == room or not dominated(b))}
    got = list(packing.fillings(left, room, slack, packing._Budget(10**6)))
    assert {tuple(sorted(f)) for _, f in got} == want and len(got) == len(want) and all(w == room - sum(f) for w, f in got)


def test_the_search_beats_best_fit_and_stops_within_its_steps():
    assert sum(n for n, _ in packing.complete_bins({6: 2, 5: 1, 4: 2, 3: 1, 2: 1}, 10)) == 3
    rng = np.random.default_rng(1)
    histogram = collections.Counter(np.clip(rng.lognormal(6, 0.9, 3000).astype(int), 1, 2048).tolist())
    for limits in ({}, {"steps": 1}, {"probes": 1}):
        plan = packing.complete_bins(histogram, 2048, **limits)
        used = collections.Counter()
        for n, items in plan:
            for x in items:
                used[x] += n
        assert used == histogram and all(sum(items) <= 2048 for _, items in plan)


def test_sharding(spark):
    rows, df = documents(spark, texts(3), shard="clash", slot="clash")
    got = sharding.shard_documents(df, 5).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {*map(len, by.values())} <= {len(rows) // 5, len(rows) // 5 + 1}
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_sharding_keeps_the_mixture_and_equals_a_plain_sort(spark, tmp_path):
    """One source with three quarters of the rows, some of hundreds and hundreds of one row."""
    sizes = [3000, 400, 200, 17, None, *[1] * 400]
    sizes[4] = 50
    rows = [(k * 10000 + i, str(k) if k != 4 else None) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sharding.interleave(df, 16, "source", ["doc_id"]).collect()
    per = collections.defaultdict(lambda: [0] * 16)
    for r in got:
        per[r["source"]][r["shard"]] += 1
    for source, placed in per.items():
        n = sum(placed)
        assert all(abs(x - n / 16) < 2 + n / 500 for x in placed), (source, placed)
    singles = [sum(placed[k] for placed in per.values() if sum(placed) == 1) for k in range(16)]
    assert min(singles) > 8 and max(singles) < 50
    hashed = {(r["doc_id"], r["source"]): (r["s"], r["u"]) for r in df.select("*", F.shiftrightunsigned(F.xxhash64(F.lit(20240607), "doc_id"), 11).alias("s"), (F.shiftrightunsigned(F.xxhash64(F.lit(sharding.SEED), F.col("source").isNull(), "source"), 11) / F.lit(float(1 << 53))).alias("u")).collect()}
    order = []
    for source in per:
        mine = sorted((hashed[i, s][0], i) for i, s in rows if s == source)
        order += [((k + hashed[mine[0][1], source][1]) / len(mine), (source is not None, source or ""), h, i) for k, (h, i) in enumerate(mine)]
    place = {i: k for k, (*_, i) in enumerate(sorted(order))}
    n = len(rows)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == {i: (q := k * 16 // n, k - -(-q * n // 16)) for i, k in place.items()}
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == n and {r["shard"]: r["n"] for r in back.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: -(-(k + 1) * n // 4) - -(-k * n // 4) for k in range(4)}


def links(docs):
    groups = collections.OrderedDict()
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    kinds = list(groups)
    sets = []
    for t in kinds:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root, count = list(range(len(kinds))), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                count[a] += 1
                count[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, t in enumerate(kinds):
        least.setdefault(find(k), []).extend(i for i in groups[t] if i is not None)
    return [(i, min(least[find(k)], default=None), count[k], len(groups[t])) for k, t in enumerate(kinds) for i in groups[t]]


@pytest.mark.parametrize("sent", [500_000, -1])
def test_near_duplicates(spark, monkeypatch, sent):
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 20)
    monkeypatch.setattr(near_duplicates, "BUCKET_TEXTS", 15)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", sent)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(120)]

    def edited():
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            words[rng.randrange(120)] = rng.choice("xyz")
        return " ".join(words)

    rows, df = documents(spark, [*[edited() for _ in range(70)], *texts(5, 20), "A  b!", "a b"], id="clash", root="clash", class_id="clash")
    key = lambda r: tuple(map(str, r))
    want = links([(r[0], r[1]) for r in rows])
    assert sorted((tuple(r) for r in near_duplicates.near_duplicates(df).collect()), key=key) == sorted(want, key=key)
    found = near_duplicates.similar_pairs(df).collect()
    kinds = collections.OrderedDict()
    for r in rows:
        kinds.setdefault(r[1] or "", []).extend([r[0]] if r[0] is not None else [])
    sets = [(min(v, default=None), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for t, v in kinds.items() if (w := WORD.findall(t.lower()))]
    exact = collections.Counter()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if 5 * len(x & y) >= 4 * len(x | y):
                exact[str(min(a, b) if None not in (a, b) else a if b is None else b), str(max(a, b) if None not in (a, b) else a if b is None else b), round(len(x & y) / len(x | y), 9)] += 1
    assert collections.Counter((str(r["a"]), str(r["b"]), round(r["similarity"], 9)) for r in found) == exact
    one = near_duplicates.one_of_each(df)
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} >= {r[1] for r in want if r[1] is not None}
    assert near_duplicates.one_of_each(df.limit(0)).count() == near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_html():
    page = (
        '<body><header><h1>Site</h1></header><nav><a href=x>m</a></nav><div class="cookie-notice">We, use</div><div id=w><h1>T&eacute;st</h1><div class="content">'
        "<p>One, two,\n three long enough here.<p>Second <b>bold</b><br>x &lt;b&gt; &amp y<ul><li>i<li>j</ul><form>f</form><script>var a='</p>';</script></div>"
        '<div class="comments"><p>A comment, yes, indeed, with, commas</p></div></div><aside>s</aside><footer>f</footer>'
    )
    assert main_text(page) == "Tést\nOne, two, three long enough here.\nSecond bold x <b> & y\ni\nj"
    assert [main_text(x) for x in ("", "<p>", "a < b", "<p>a<script>x", "<!-- x", "<div>" * 3000 + "deep")] == ["", "", "a < b", "a", "", "deep"]
    assert main_text("<article><header><h1>Ti</h1><p>by me</p></header><section><p>Hi</p></section></article>") == "Ti\nHi"


def test_ties_of_buckets_connect_what_all_pairs_connect(monkeypatch):
    rng = np.random.default_rng(16)
    centre = rng.integers(0, 256, (12, 216), dtype=np.uint8)
    values = centre[rng.integers(0, 12, 300)]
    noise = rng.random(values.shape) < rng.choice([0.0, 0.05, 0.15, 0.5], 300)[:, None]
    values = np.where(noise, rng.integers(0, 256, values.shape), values).astype(np.uint8)
    bucket = np.sort(rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, *range(8, 60)], 300))
    least = near_duplicates._least_matches(208)
    for side in (None, np.where(bucket % 2 == 0, rng.integers(0, 2, 300), -1)):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
        fit = (i < j) & (bucket[i] == bucket[j]) & (True if side is None else (side[i] < 0) | (side[i] != side[j]))
        i, j = i[fit], j[fit]
        stay = near_duplicates._stay(values, i, j, least)

        def parts(left, right):
            sets = near_duplicates._Sets()
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                sets.join(a, b)
            names = collections.defaultdict(list)
            for k, n in sets.number.items():
                names[sets.find(n)].append(k)
            return sorted(sorted(x) for x in names.values())

        assert len(stay) > 20 and parts(i[stay], j[stay]) == parts(*near_duplicates.bucket_ties(values, bucket, side))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content has-sidebar"><p>Some text, with commas, of the article.</p><p>More of it.</p></div>', "Some text, with commas, of the article.\nMore of it."),
        ('<div class="post social-post"><p>Some text, with commas, of the article.</p></div><div class="share-bar"><p>Share it</p></div>', "Some text, with commas, of the article."),
        ("<article><p>a<script src=/a/>var x=1;</script></p><p>b</p></article>", "a\nb"),
        ('<article><p title=5">a b</p></article>', "a b"),
        ("<article><p title='it\"s > so'>a</p></article>", "a"),
        ("<article><p>a</p><svg><path d=1 /><text>t</text></svg><p>b</p><br/><p/>c</article>", "a\nb\nc"),
        ('<form id="all"><div><p>' + "An article, in a form, of some length. " * 8 + "</p></div><input></form>", ("An article, in a form, of some length. " * 8).strip()),
        ('<div class="cookie notice">We use cookies.</div>', ""),
        ("<article><p>a</p><div class='comments'>" + "<p>A comment, long, and with commas, more than the article.</p>" * 9 + "</div></article>", "a"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><p>a<textarea><p>x</textarea><p>b<!-- <p>c --><![CDATA[ d ]]><p", "a\nb"),
    ],
)
def test_html_cases(page, text):
    assert main_text(page) == text


_LONG = "A long paragraph of the article, with commas, and many more words in it than other ones have."


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<section id="search"><h2>Search</h2><p>Text on search.</p></section>', "Search\nText on search."),
        ('<section id="navigation"><p>Text of a section.</p></section>', "Text of a section."),
        ('<div class="alert"><p>Careful here, reader.</p></div>', "Careful here, reader."),
        ('<div class="reply"><p>He replied so.</p></div>', "He replied so."),
        ('<p class="social">Social matters.</p>', "Social matters."),
        ('<h2 id="comments">Comments</h2>', "Comments"),
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<p id="header-format">The header has a format.</p>', "The header has a format."),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>", "so x=2"),
        ("<label>A label</label>", "A label"),
        ("<xmp><b>shown</b> &amp;</xmp>", "<b>shown</b> &amp;"),
        ('<ul><li><a href="a">A long title of a book for further reading</a></li><li><a href=b>Another long title of an essay</a></li></ul>', "A long title of a book for further reading\nAnother long title of an essay"),
        ('<div class="ad">Buy now, cheap.</div>', None),
        ('<p class="sponsored">Buy now, cheap.</p>', None),
        ('<div class="comments"><div class="comment">Nice!</div><div class="comment">Yes.</div></div>', None),
        ("<form><label>Mail</label><p>Your mail</p><input></form>", None),
        ('<div class="share"><a href=x>Share this</a></div>', None),
        ('<div class="widget"><p>Get our mail.</p><input></div>', None),
        ("<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul>", None),
        ('<div role="alert">Session ends</div>', None),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_alone_drop_nothing_among_paragraphs(inside, text, tag):
    page = f"<body><nav><a href=x>home</a></nav><{tag}><h1>Title</h1><p>{_LONG}</p>{inside}<p>{_LONG}</p></{tag}><footer>f</footer></body>"
    assert main_text(page) == "\n".join(["Title", _LONG, *([text] if text is not None else []), _LONG])


def test_short_pages_and_siblings_of_articles():
    assert main_text('<div class="widget content"><p>Short note only.</p></div>') == "Short note only."
    assert main_text("<form><p>Please log in</p><input></form>") == ""
    assert main_text(f"<div><article><p>{_LONG}</p></article><article><p>{_LONG} b</p></article><article class='comment'><p>{_LONG} c</p></article></div>") == f"{_LONG}\n{_LONG} b"


def test_hostile_pages_take_linear_time():
    n = 20_000
    pages = ["<a " * 10 * n, "<div>" * n + "</span>" * n, "<span>" + "<div>" * n + "</span>" * n, "<span><td>" + "<b>" * n + "</span>" * n, "<p>" + "a<b>b</b>" * n, "<header>" * n + "<h1>x" * n, '<p title="' * n, "<ul><li>" * n]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 4, page[:30]


class _Article(html.parser.HTMLParser):
    """A plain reading of what is inside <article>: blocks of text outside of elements that are never part of one."""

    SKIP = {"nav", "form", "aside", "footer", "script", "style", "figure-ad"}

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.text = [], [], ""
        self.feed(page)
        self.end()

    def end(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        inline = tag in ("a", "b", "i", "em", "strong", "span", "code", "u", "br", "img", "small", "sup", "sub")
        if not inline:
            self.end()
            if "p" in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index("p") :]
        if tag == "br":
            self.text += " "
        elif tag not in ("img", "hr", "meta", "link", "input"):
            bad = tag in self.SKIP or {"ad", "comments", "comment", "share", "related", "cookie", "newsletter"} & set((dict(attrs).get("class") or "").split())
            self.open.append("SKIP" if bad else tag)
            self.names = {**getattr(self, "names", {}), len(self.open): tag}

    def handle_endtag(self, tag):
        names = [self.names[k + 1] for k in range(len(self.open))]
        if tag in names:
            k = len(names) - 1 - names[::-1].index(tag)
            if any(n not in ("a", "b", "i", "em", "strong", "span", "code", "u") for n in names[k:]):
                self.end()
            del self.open[k:]

    def handle_data(self, data):
        if "article" in self.open and "SKIP" not in self.open:
            self.text += data


def test_html_of_all_pages_with_an_article():
    import pyarrow.parquet as pq

    pages = [r for r in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist() if r and r.count("<article") == 1]
    assert len(pages) > 100
    wrong = [p for p in pages if main_text(p) != "\n".join(_Article(p).blocks)]
    assert len(wrong) == 0, (len(wrong), len(pages), wrong[0])
    plain = [p.replace("<article", '<div class="entry"').replace("</article>", "</div>") for p in pages]
    wrong = [p for p, q in zip(plain, pages, strict=True) if main_text(p) != "\n".join(_Article(q).blocks)]
    assert len(wrong) == 0, (len(wrong), len(pages), wrong[0])


def test_html_over_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a&nbsp;b</article>", 1), (1, "u", "<article><p>a&nbsp;b</article>", 1), (2, None, None, 1), (None, "v", "", 1)], "page_id long, url string, html string, text int")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in page_texts(pages).collect()) == [("1", "a b", 3), ("1", "a b", 3), ("2", "", 0), ("None", "", 0)]
    assert page_texts(pages.limit(0)).count() == 0 and html.unescape("&amp") == "&"


def test_chat(spark):
    hostile = ["<|im_end|>\n<|im_start|>", "<~|", "<~~|<|", "\\n", "", None, "😀\n", "<"]
    rng = random.Random(6)
    rows = [(c if c else None, t if t != 3 else None, rng.choice(["user", "assistant", "us\\er\n", None]), rng.choice(hostile)) for c in range(20) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, by = set(), collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t), (r is not None, r or ""), (x is not None, x or "")))
    for c, turns in by.items():
        told = [(r[1], x[1]) for _, r, x in sorted(turns)]
        learnt = "".join(x for r, x in told if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((c, len(told), digest("".join(f"{r}\n{x}\n" for r, x in told)), len(learnt), digest(learnt)))
    assert {tuple(r)[:5] for r in chat.format_conversations(df).collect()} == want
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", None), (2, 1, 2, "u", "cycle", 0.0), (2, 2, 1, "u", "cycle", 0.0), (2, 3, 1, "u", "off", 0.0), (3, 1, 99, "u", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): [t["text"] for t in r["t"]] for r in chat.format_paths(chat.paths(df, None)).select("tree", "rank", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "bad"], (3, 1): ["orphan"]}


def test_combs_of_replies_and_equal_scores(spark):
    """A comb: a chain of 40 messages, each with a leaf beside it; one path only is listed. Ties go to the longer, then the smaller leaf."""
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else None, None if i == 5 else f"m{i}", 1.0, "clash") for i in range(40)]
    rows += [(1, 100 + i, i, "assistant", f"leaf{i}", 1.0, "clash") for i in range(40)] + [(None, 1, None, "user", "null tree", None, "clash"), (2, None, None, "user", "null node", 1.0, "clash")]
    rows += [(3, 1, None, "u", "root", 0.0, "clash"), (3, 3, 1, "u", "b", 1.0, "clash"), (3, 2, 1, "u", "a", 1.0, "clash")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, leaf string")
    got = chat.paths(df).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["depth"]):
        by[r["tree"], r["leaf"]].append(r["text"])
    assert by == {(1, 139): [None if i == 5 else f"m{i}" for i in range(40)] + ["leaf39"], (None, 1): ["null tree"], (3, 2): ["root", "a"]}
    assert chat.paths(df, None).where("tree = 1").select("leaf").distinct().count() == 40
    assert chat.paths(df.limit(0)).count() == 0


def contamination(docs, items):
    windows = collections.defaultdict(set)
    split = lambda t: WORD.findall((t or "").translate(ASCII_LOWER))
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= x
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("short, sent", [(True, 500_000), (False, 500_000), (True, -1)])
def test_decontamination(spark, monkeypatch, short, sent):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", sent)
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice(["a", "B", "É", "é", "c1", "İ", "Σ"][: rng.choice([2, 7])]) for _ in range(n))
    items = [(k, some(rng.choice(([0, 1, 3, 12] if short else [13]) + [13, 14, 20, 40]))) for k in range(25)] + [(None, some(20)), (3, some(15))] + ([(50, None)] if short else [])
    rows, df = documents(spark, [None if k % 9 == 0 else f"{some(rng.choice([0, 5, 13, 100]))} {rng.choice(items)[1] or ''}.{some(5)}" for k in range(50)], key=1, items=2)
    rows = [*rows, (900, " ".join(some(100) for _ in range(2000)) + " " + items[0][1], None, None, 0)]  # about a megabyte
    df = df.unionByName(spark.createDataFrame(rows[-1:], DOCS).withColumns({"key": F.lit(1), "items": F.lit(2)}))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want, key = contamination([(r[0], r[1]) for r in rows], items), lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in decontamination.contamination(df, bench).collect()), key=key) == sorted(want, key=key)
    assert decontamination.clean_documents(df, bench).count() == sum(not r[5] for r in want)
    assert decontamination.contamination(df, bench.limit(0)).where("contaminated").count() == decontamination.contamination(df.limit(0), bench).count() == 0


def test_sigma_at_the_end_of_a_word(spark):
    words = ["\u0391\u03a3", "a", "\u0392"] * 5
    docs = spark.createDataFrame([(1, ".".join(words)), (2, " ".join(words)), (3, "'".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ", ".join(words))], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.contamination(docs, bench).collect()] == [15] * 3


def test_stages_keep_columns_with_clashing_names(spark):
    docs, labels = labelled(spark)
    names = ["__key", "__id", "__toxicity", "key", "id", "row", "score", "site", "a.b", "evidence", "label"]
    docs = docs.where("doc_id < 60").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    bench = spark.createDataFrame([(1, "never to be seen")], "item_id long, text string")
    for out in (quality.accepted_documents(docs, labels), toxicity.clean_documents(docs, labels), near_duplicates.one_of_each(docs), decontamination.clean_documents(docs, bench)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def labelled(spark):
    rng = random.Random(8)
    good, toxic = [f"{a}{b}" for a in "bdfgl" for b in "aeiou"], ["zurk", "zurkel", "zog"]
    rows, labels = [], []
    for i in range(900):
        bad, nasty = i % 7 == 0, i % 5 == 0
        words = [rng.choice(good) for _ in range(40)] + ([rng.choice(toxic)] * 2 if nasty else [])
        rng.shuffle(words)
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + ".", "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), int(nasty)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learnt_operators_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = quality.classify(docs, labels).join(labels.withColumnRenamed("quality", "want"), "doc_id").where(toxicity.held_out()).collect()
    assert sum(r["accepted"] == bool(r["want"]) for r in held) >= 0.97 * len(held)


def test_learnt_operators_on_odd_rows(spark):
    _, labels = labelled(spark)
    rows, df = documents(spark, texts(9, 10), evidence="clash", score=1, quality=2)
    for known in (labels, labels.limit(0)):
        assert toxicity.toxicity(df, known).count() == quality.classify(df, known).count() == len(rows)
        assert toxicity.clean_documents(df, known).columns == quality.accepted_documents(df, known).columns == df.columns
    assert toxicity.toxicity(df.limit(0), labels).count() == quality.classify(df.limit(0), labels).count() == 0


def test_weights_are_those_of_plain_ftrl():
    """The published update, one coordinate after the other, on rows of a few places."""
    rng = random.Random(17)
    rows = [(y := rng.randint(0, 1), sorted({rng.randrange(40) + 40 * y * (rng.random() < 0.5) for _ in range(rng.randint(1, 9))} | {1 << toxicity.BITS})) for _ in range(400)]
    z, n, w = collections.defaultdict(float), collections.defaultdict(float), {}

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for y, places in rows:
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in places:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    place, got = toxicity.learn([(y, np.array(p, dtype=np.int32)) for y, p in rows], epochs=3)
    assert len(want) > 10 and set(place.tolist()) == set(want) and np.allclose(got, [want[i] for i in place.tolist()], rtol=1e-9)


def test_features_are_words_stems_pairs_and_skips():
    """Equal places for equal features, whatever text they stand in, and as many as a plain listing has."""
    one, owners = toxicity.features(["red green blue", "", "GREEN, blue", "greenish"])
    assert np.bincount(owners, minlength=4).tolist() == [3 + 3 + 2 + 1, 0, 2 + 2 + 1, 1 + 1]
    sets = [set(one[owners == k].tolist()) for k in range(4)]
    assert sets[2] <= sets[0] and len(sets[0] & sets[3]) == 1  # the stem "gree"


def test_the_sample_is_of_labels_that_have_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}" + " x" * (i % 5)) for i in range(300)] + [(7, "another text"), (None, "no id"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)] + [(7, 1), (11, None), (None, 1)], "doc_id long, toxic int")
    free = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = toxicity.labelled(docs, labels, "toxic", 10_000).collect()
    assert len(rows) == len(free)
    few = toxicity.labelled(docs, labels, "toxic", 50).collect()
    assert len(few) == 50 and {r["order"] for r in few} == set(sorted(r["order"] for r in rows)[:50])
    small = toxicity.labelled(docs, labels, "toxic", 10_000, size=200).collect()
    assert 10 < len(small) < 40 and sum(len((r["text"] or "").encode()) for r in small) <= 200
    by = {r["order"]: r["text"] for r in rows}
    seven = docs.where("doc_id = 7").select(F.xxhash64("doc_id")).first()[0]
    assert seven not in by or by[seven] == "another text"
    assert toxicity.labelled(docs.limit(0), labels, "toxic", 50).count() == 0


def test_posteriors_are_those_of_plain_empirical_bayes(spark):
    rng = random.Random(18)
    rows = [(i, rng.choice("aaaabc") if i % 50 else f"rare{i}", rng.choice(["en", "de", None]), rng.gauss(0.5, 2)) for i in range(600)]
    seen = spark.createDataFrame(rows, "doc_id long, source string, lang string, evidence double")
    chance = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    total, mean = len(rows), sum(chance(r[3]) for r in rows) / len(rows)

    def strength(spread, groups):
        between = spread - mean * (1 - mean) * groups / total
        return min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1))

    host, path = collections.defaultdict(lambda: [0.0, 0]), collections.defaultdict(lambda: [0.0, 0])
    for _, s, g, e in rows:
        for sums in (host[s], path[s, g]):
            sums[0] += chance(e)
            sums[1] += 1
    k_host = strength(sum(g * g / n for g, n in host.values()) / total - mean * mean, len(host))
    at = {s: (k_host * mean + g) / (k_host + n) for s, (g, n) in host.items()}
    k_path = strength(sum((g / n - at[s]) ** 2 * n for (s, _), (g, n) in path.items()) / total, len(path))
    want = {}
    for i, s, g, e in rows:
        others = (mean * total - chance(e)) / (total - 1)  # the document itself is left out of all three
        above = (k_host * others + host[s][0] - chance(e)) / (k_host + host[s][1] - 1)
        posterior = (k_path * above + path[s, g][0] - chance(e)) / (k_path + path[s, g][1] - 1)
        want[i] = (above, posterior, chance(e + logit(posterior) - logit(others)))
    known, told = quality.sites(seen, F.col("source"), F.col("lang"))
    got = quality.combine(seen, known, told, F.col("source"), F.col("lang")).collect()
    assert len(got) == 600
    for r in got:
        assert np.allclose((r["host_posterior"], r["path_posterior"], r["quality"]), want[r["doc_id"]], rtol=1e-9) and r["accepted"] == (r["quality"] >= 0.5)


def test_a_lone_document_does_not_vouch_for_itself(spark):
    """Among hosts of strong opinions the only document of a host keeps the odds of its own evidence."""
    rows = [(f"h{h}", "en", 6.0 if h % 2 else -6.0) for h in range(40) for _ in range(25)] + [("alone", "en", 1.5)]
    seen = spark.createDataFrame(rows, "source string, lang string, evidence double")
    known, told = quality.sites(seen, F.col("source"), F.col("lang"))
    one = quality.combine(seen, known, told, F.col("source"), F.col("lang")).where("source = 'alone'").first()
    assert told["host_strength"] < 1.5 and abs(one["quality"] - 1 / (1 + math.exp(-1.5))) < 1e-6


def test_sparse_sites_lean_on_the_whole(spark):
    seen = spark.createDataFrame([("big", "en", 3.0)] * 50 + [("bad", "en", -3.0)] * 50 + [("one", "en", -3.0)], "source string, lang string, evidence double")
    known, told = quality.sites(seen, F.col("source"), F.col("lang"))
    rows = {r["source"]: r for r in quality.combine(seen, known, told, F.col("source"), F.col("lang")).collect()}
    at = {k: r["host_posterior"] for k, r in rows.items()}
    assert at["bad"] < at["one"] < told["good"] / told["n"] + 0.01 < at["big"] and abs(rows["one"]["quality"] - 1 / (1 + math.exp(3))) < 1e-6


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 16)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (None, x[1].tolist()), (1200, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300]
    for q, found in got.items():
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10]
        assert len(set(best) & {v for v, _ in found}) >= 9 and np.allclose([s for _, s in found], [d[v] for v, _ in found], rtol=1e-12)
    assert neighbours.search(df.limit(0)).count() == 0


def test_beams_that_hold_all_sums_find_the_best_one():
    rng = np.random.default_rng(13)
    books, x = rng.normal(size=(3, 4, 5)), rng.normal(size=(50, 5))
    codes, norms = neighbours.beam_search(x, books, beam=64)
    sums = (books[0][:, None, None] + books[1][None, :, None] + books[2][None, None]).reshape(64, 5)
    best = ((x[:, None] - sums) ** 2).sum(2).argmin(1)
    assert (codes @ [16, 4, 1] == best).all() and np.allclose(norms, (sums[best] ** 2).sum(1))
    wide, narrow = (sum(np.linalg.norm(x - sum(w[c] for w, c in zip(books, neighbours.beam_search(x, books, b)[0].T, strict=True)), axis=1)) for b in (4, 1))
    assert wide <= narrow


def test_codes_tell_near_from_far():
    """The codes alone, without exact ranking, on 5,000 clustered vectors: far more than the candidates looked at."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(50, 16))[rng.integers(0, 50, 5000)] * 3 + rng.normal(size=(5000, 16))
    books = neighbours.fit(x, books=8, words=64)
    codes, norms = neighbours.beam_search(x, books)
    made = sum(w[codes[:, b]] for b, w in enumerate(books))
    assert np.allclose(norms, (made**2).sum(1)) and ((x - made) ** 2).sum() < 0.15 * (x**2).sum()
    found = 0
    for q in range(0, 5000, 100):
        exact, near = ((x - x[q]) ** 2).sum(1), norms - 2 * sum((w @ x[q])[codes[:, b]] for b, w in enumerate(books))
        exact[q] = near[q] = np.inf
        found += len({*np.argsort(exact)[:10].tolist()} & {*np.argsort(near)[:100].tolist()})
    assert found >= 0.9 * 500


def test_vectors_of_other_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(15)
    rows = [(i, rng.normal(size=4).tolist(), "x") for i in range(60)] + [(i, rng.normal(size=3).tolist(), "x") for i in range(60, 80)] + [(100, [], "x"), (0, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string").withColumns({"code": F.lit(1), "norm": F.lit(2)})
    got = neighbours.search(df, every=20).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40} and all(r["vec_id"] < 60 for r in got) and len(got) == 30
    assert neighbours.search(df.where("vec_id = 0"), every=20).count() == 0


def test_neighbours_of_thousands_of_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 8))
    x[rng.permutation(6000)[:2000]] = x[0]
    near = rng.permutation(6000)[:2000]
    x[near] = x[100] + rng.normal(size=(2000, 8)) * 1e-4
    x[200] = x[100]
    got = collections.defaultdict(list)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in neighbours.search(df, every=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 150
    for q, found in got.items():
        d = np.sqrt(np.add.reduce(((x - x[q]) ** 2).T.copy(), axis=0))
        d[q] = np.inf
        assert found == np.lexsort((np.arange(6000), d))[:10].tolist()
