"""The pipeline's stages, each against a plain version of its own."""

import corpus_pipeline
from brindle.llm import bpe
from brindle.llm.queries import vocabulary
from brindle.plans.tables import table
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    extra = spark.createDataFrame([(90001, "12345 !!", "en", "junk", 8), (90002, None, "en", "junk", 0), (90003, "ひらがなのぶんしょうです" * 9, None, "junk", 108)], docs.schema)
    docs = docs.union(extra)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
        old = {r.doc_id: r for r in before.collect()}
        if name != "packing":
            assert docs.columns == columns
            assert len(rows[name]) == len({r.doc_id for r in rows[name]})
        ids = {r.doc_id for r in rows[name]}
        if name == "language_id":
            assert old.keys() - ids == {90001, 90002, 90003}
        elif name == "minhash_dedup":
            assert ids == {d for d, _, _, kept in near_groups([(r.doc_id, r.text) for r in old.values()], 5) if kept}
        elif name == "suffix_dedup":
            seen = set()
            left = {r.doc_id: r.text for r in rows[name]}
            for d in sorted(old):
                data = old[d].text.encode()
                own = {data[i : i + 50] for i in range(len(data) - 49)}
                gone = bytearray(len(data))
                for i in range(len(data) - 49):
                    if data[i : i + 50] in seen:
                        gone[i : i + 50] = b"\1" * 50
                seen |= own
                if not any(gone):
                    assert left[d] == old[d].text
                elif all(gone):
                    assert d not in left
                else:
                    kept = bytes(b for b, g in zip(data, gone) if not g)
                    assert abs(len(left[d].encode()) - len(kept)) <= 4 * (bytes(gone).count(b"\0\1") + 1)
        elif name == "decontamination":
            assert old.keys() - ids == {d for d, r in old.items() if any(x in r.text for x in items)}
    texts = rows["decontamination"]
    check_pieces(texts, rows["packing"])
    assert sum(p.length for p in rows["packing"]) == sum(len(bpe.library(vocabulary()).encode(r.text).ids) + 1 for r in texts)


def test_run_is_all_stages(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_empty_table_and_columns_of_any_name(spark, tmp_path):
    """Every stage on a table with columns named like those that operators use, whole and without rows."""
    whole = table(spark, SF, "documents").selectExpr("*", "1 _score", "'x' _lang_pred", "2L block", "'b' data", "3 gone", "4 slot", "5 c0", "6 _text", "7 _n_grams")
    for empty in (False, True):
        docs = whole.limit(0) if empty else whole
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{empty}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{empty}-{name}")
            if name != "packing":
                assert docs.columns == whole.columns
            assert (docs.count() == 0) == empty

