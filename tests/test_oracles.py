import os
import sys

import pandas as pd
import pytest

from brindle.queries import ORACLES, QUERIES
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("case", ["halves", "characters"])
def test_hash_embedding_equals_sql(spark, tmp_path, case):
    """Counts whose ten-thousandths lie next to a half (11 of a length of sqrt(445): 5214.50009), and all characters, alone and in words."""
    if case == "halves":
        texts = [f"{'x ' * (11 * k)}{'y ' * (18 * k)}" for k in range(1, 9)] + [f"{'x ' * a}{'y ' * b}" for a in range(0, 60, 3) for b in range(0, 60, 3)]
    else:
        known = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
        texts = [" ".join(f"{c} a{c} A{c}b" for c in known[at : at + 256]) for at in range(0, len(known), 256)] + ["", "?", None, "ΟΔΟΣ ΣΑΣ, ς", "İx Iı"]
    for t in TABLES:
        if t != "documents":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    compare(spark, QUERIES["hash_embedding"], ORACLES["hash_embedding"], str(tmp_path))
