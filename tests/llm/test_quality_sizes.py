"""The quality verdict does not depend on the size of the table: clean rows without a label stay, bad rows go."""

import pytest

pytest.importorskip("public_tokenizers")

from airflux.llm import queries  # noqa: E402


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_clean_rows_stay(spark, tmp_path, sf):
    """Every third clean label is held back; its row must not be lost for want of it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    clean = labels.where("quality = 1 and toxic = 0")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean.where("pmod(xxhash64(doc_id), 3) > 0").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op1_quality_rules"](spark, str(tmp_path)).where("not base_failed")
    got.write.parquet(f"{tmp_path}/scored")
    got = spark.read.parquet(f"{tmp_path}/scored")
    held = got.join(clean.where("pmod(xxhash64(doc_id), 3) = 0"), "doc_id", "left_semi")
    n, lost = held.count(), held.where("not kept").count()
    assert n > 10 and lost <= 0.01 * n, (lost, n)
    bad = got.join(labels.where("quality = 0 or toxic = 1"), "doc_id", "left_semi")
    assert bad.where("not kept").count() > 0.1 * bad.count()
