"""The pipeline on planted documents: what each stage must take away, and the sequences of what is left."""

import random
import zlib

import corpus_pipeline
from codeweft.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "s", "")]
    prose = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    passage = prose(40)
    rows, labels, gone = [], [], {}
    for i in range(600):
        text = prose(rng.randint(60, 120))
        if i % 6 == 0:
            gone[i], text = "quality_classifier", " ".join(w.upper() + "!!" for w in text.split())
        elif i % 6 == 1:
            gone[i], text = "toxicity", f"{text} zurk {prose(5)} zog {prose(5)} zurk"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(gone.get(i) != "quality_classifier"), int(gone.get(i) == "toxicity")))
    clean = [r for r in rows if r[0] not in gone]
    near = clean[3][1].split()
    near[5] = "other"
    planted = [(1000, clean[0][1], "exact copy"), (1001, " ".join(near), "near copy"), (1002, f"{prose(30)} {passage} {prose(30)}", "contaminated")]
    rows += [(i, t, "en", "s0", len(t)) for i, t, _ in planted]
    gone |= {1000: "ngram_jaccard_join", 1001: "ngram_jaccard_join", 1002: "benchmark_decontamination"}
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left -= {i for i, at in gone.items() if at == name}
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(left), name
    lib, texts = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), {r[0]: r[1] for r in rows}
    want = set()
    for i in left:
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048, len(part := ids[k : k + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))) for k in range(0, len(ids), 2048)}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed} == want and len(packed) == len(want)
    assert len({r["sequence_id"] for r in packed}) == -(-sum(r["length"] for r in packed) // 2048)
