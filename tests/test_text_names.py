"""Names from texts by their ends and beginnings, and rows of one row group dealt out."""

from pyspark.sql import functions as F

from stridegrid.functions import text as TX
from stridegrid.plans.blocks import spread

TEXTS = [
    None, "", " ", "_", "__a__B  c__", "\t\x0b x y \r\n", "a  ", " a b\x85", " ", "   ", "a/b", "..\\x", "Ünï cödé-9", "--", "a \n ",
    "x ", "K İI", "é" * 500 + "b", "ab. " * 100, "-" * 119 + "  " + "zz", "q" * 130, "\0", "😀 a 😀",
]


def test_names_are_those_of_the_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    strip = F.regexp_replace(t, r"^\s+|\s+$", "")
    token = F.regexp_replace(F.lower(strip), r"[^a-zA-Z0-9_-]+", "_")
    token = F.regexp_replace(F.regexp_replace(token, "_+", "_"), "^_+|_+$", "")
    name = F.substring(F.regexp_replace(t, r"[^a-zA-Z0-9._-]+", "_"), 1, 120)
    bad = (strip == "") | strip.contains("/") | strip.contains("\\") | strip.contains("\0")
    want = [F.when(token == "", "run").otherwise(token), F.when(name == "", "export").otherwise(name), F.when(~bad, strip), strip]
    got = [TX.safe_token(t), TX.safe_file_name(t), TX.valid_run_id(t), TX._strip(t)]
    for row in df.select("t", F.array(*got).alias("got"), F.array(*want).alias("want")).collect():
        assert row.got == row.want, row.t


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(3_000).withColumn("t", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    dealt = spread(one, F.col("id"))
    assert tasks(one) == 1 and tasks(dealt) > 1 and dealt.count() == 3_000
    assert sorted(r[0] for r in dealt.select("id").collect()) == list(range(3_000))
