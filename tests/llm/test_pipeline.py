"""The pipeline on a small corpus, stage by stage against what each must do."""

import random

import corpus_pipeline
from tests.llm.test_media_pack import check_packing


def corpus(rng):
    words = {
        "en": "the and ing tion with er th of at".split(),
        "fr": "les que eux ment dans oui ère ou an".split(),
    }
    text = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(("en", "fr")[i % 2], rng.randint(20, 120)), ("en", "fr")[i % 2]) for i in range(40)]
    return rows, text


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    rows, text = corpus(rng)
    passage = text("en", 15)
    base = text("fr", 60).split()
    near = [*base[:30], "autre", *base[31:]]
    rows += [
        (100, None, "en"), (101, "12 34 -- !!", None), (102, " ".join(base), "fr"), (103, " ".join(near), "fr"), (104, " ".join(base), "fr"),
        (105, f"{text('en', 30)} {passage.upper()} {text('en', 10)}", "en"), (106, text("en", 20) + " password=hunter2hunter2 " + text("en", 5), "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0] for r in rows}
    gone = {"language_id": {100, 101}, "near_duplicates": {103, 104}, "decontamination": {105}, "secret_scan": set()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids -= gone[name]
        assert {r.doc_id for r in now.collect()} == ids, name
    masked = now.where("doc_id = 106").first().text
    assert "hunter2" not in masked and "[secret]" in masked
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids and check_packing(packed, 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(packed)


def test_stages_take_any_column_and_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    rows, text = corpus(rng)
    names = ["score", "lang_pred", "_first", "_bad_id", "_id", "_spans", "_cut", "row", "id", "own", "Own_Key", "text_key", "parts", "end", "spans", "n_hit"]
    shape = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names)
    secret = rows[1][1] + " password=hunter2hunter2"
    full = [(i, t, lang, None, len(t), *names) for i, t, lang in rows]
    full += [(None, rows[0][1] + " one more", None, None, None, *names), (7, rows[7][1], "fr", None, 3, *names), (900, secret, None, "s", None, *[None] * len(names))]
    full += [(901, "", "en", "s", 0, *names), (902, "x" * 200_000 + " " + text("en", 3000), "en", "s", 1, *names)]
    docs = spark.createDataFrame(full, shape)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/odd{k}")
        now = spark.read.parquet(f"{tmp_path}/odd{k}")
        counts.append(now.count())
        extra = now.where("doc_id is not null and doc_id <> 900").first()
        assert [extra[c] for c in names] == names
    # the empty text goes; 900 repeats 1; both rows of 7 and the null id stay
    assert counts == [len(full) - 1, len(full) - 2, len(full) - 2, len(full) - 2]
    assert now.where("doc_id = 7").count() == 2 and now.where("doc_id is null").count() == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert check_packing(packed.collect(), 2048)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
