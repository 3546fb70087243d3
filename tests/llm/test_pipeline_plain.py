"""The stages of the pipeline against plain versions, on whole tables and on odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard import plain as plain_groups
from test_packing import check
from test_substrings import kept

from tidemark.llm import secrets, toxicity

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def masked(text):
    spans, out, done = secrets.all_spans(text or "")[1], [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], "[secret]"]
        done = max(done, b)
    return text if not out else "".join([*out, text[done:]])


def test_each_stage_equals_its_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    given = texts(docs)
    clean = texts(STAGES["toxicity"](spark, docs, SF))
    rejected = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    assert clean == {i: t for i, t in given.items() if i not in rejected} and rejected
    one = texts(STAGES["jaccard_join"](spark, docs, SF))
    assert one == {i: given[i] for i, _, c in plain_groups(list(given.items())) if c == i}
    cut = texts(STAGES["substring_dedup"](spark, docs, SF))
    assert cut == {i: " ".join(left) if len(left) < len(w) else given[i] for i, w, left in kept(list(given.items()), 20)}
    assert texts(STAGES["secret_scans"](spark, docs, SF)) == {i: masked(t) for i, t in given.items()}


def test_odd_rows_go_through_all_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, "a b c d e f g h", "x", 1), (1, "a b c d e f g h", "x", 1), (2, None, "x", 2), (3, "", "x", 3), (4, long, "x", 4), (5, long + " end", "x", 5), (6, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "x", 6)]
    rows += [(10 + k, f"hot line {'of many words that all of these share ' * 3} {k} {k * 7919}", "hot", k) for k in range(60)]
    docs = spark.createDataFrame([(*r, "y", "z") for r in rows], "doc_id bigint, text string, source string, n_chars bigint, id__ string, th__ string")
    columns = docs.columns
    for name, stage in list(STAGES.items())[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    left = texts(docs)
    assert {2, 3, 4, 6} <= set(left) and 5 not in left and left[2] is None and left[3] == "" and left[4] == long
    assert left[6] == 'x [secret]"' and docs.where("doc_id = 1").count() == 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(STAGES["best_fit_packing"](spark, docs, SF).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], library, 2048)
    assert docs.where(F.col("id__") != "y").count() == 0
