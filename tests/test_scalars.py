import pytest
from pyspark.sql import functions as F

from runscope.functions import scalars as S


def one(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("seconds", "text"), [(5.0, "5s"), (125.0, "2m 5s"), (120.0, "2m"), (7200.0, "2h"), (11040.0, "3h 4m"), (-1.0, "0s"), (float("inf"), "unknown")])
def test_duration_text(spark, seconds, text):
    assert one(spark, S.duration_text(F.col("s")), s=seconds) == text


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (3 * 1024**3, "3 GB"), (-1, "0 B"), (1024**5, "1.0 PB"), (None, "0 B")])
def test_size_text(spark, size, text):
    assert one(spark, S.size_text(F.col("s")), s=size) == text


def test_percent_at_most_one_is_a_fraction(spark):
    assert [one(spark, S.percent_text(F.col("p")), p=p) for p in (0.5, 1.0, 37.5, 250.0, -1.0)] == ["50.0%", "100.0%", "37.5%", "100.0%", "0.0%"]


def test_wildcards_last_duplicate_wins_and_parts_without_equals_go(spark):
    assert one(spark, S.wildcards(F.col("t")), t="a=1, b=2, junk, a=3, c=x=y") == {"a": "3", "b": "2", "c": "x=y"}


def test_timestamp_line(spark):
    assert one(spark, S.timestamp(F.col("l")), l="[Mon Jan  6 10:00:00 2025]") == 1736157600.0
    assert one(spark, S.timestamp(F.col("l")), l="[Mon Foo  6 10:00:00 2025]") is None


@pytest.mark.parametrize(("line", "kind"), [("rule a:", "rule_start"), ("localcheckpoint b:", "rule_start"), ("    rule c:", "rule_start"), ("    jobid: 3", "jobid"), ("    wildcards: a=1", "wildcards"), ("[Mon Jan  6 10:00:00 2025] Finished job 5.", "timestamp"), ("Finished jobid: 5 (Rule: x)", "job_finished"), ("Error in rule x:", "error"), ("3 of 10 steps (30%) done", "progress"), ("", "none")])
def test_line_type(spark, line, kind):
    assert one(spark, S.line_type(F.col("l")), l=line) == kind


def test_code_hash_ignores_white_space(spark):
    assert one(spark, S.code_hash(F.col("c")), c="a  b\n c") == one(spark, S.code_hash(F.col("c")), c=" a b c ")
    assert one(spark, S.code_hash(F.col("c")), c=" \n") is None


def test_combination_key(spark):
    m = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, S.combination_key(m, F.lit(4))) == "a=1:b=2:threads=4"
    assert one(spark, S.combination_key(F.lit(None).cast("map<string,string>"), F.lit(None).cast("int"))) is None


def test_eta_text(spark):
    eta = S.eta_text(*[F.col(c) for c in "sluc"])
    assert one(spark, eta, s=100.0, l=95.0, u=105.0, c=0.8) == "~1m 40s"
    assert one(spark, eta, s=100.0, l=10.0, u=190.0, c=0.5) == "10s - 3m 10s"
    assert one(spark, eta, s=100.0, l=10.0, u=190.0, c=0.05).endswith("(very rough)")


def test_size_text_of_other_units(spark):
    of = lambda value, **o: one(spark, S.size_text(F.col("s"), **o), s=value)
    assert of(1536, precision=2) == "1.50 KB"
    assert of(1500, binary=False) == "1.5 KB"
    assert of(2000, binary=False) == "2 KB"
    rate = lambda value: one(spark, S.size_rate_text(F.col("s")), s=value)
    assert [rate(x) for x in (0.0, 1536.0, 1048576.0, -2.0, 0.25)] == ["0 B/s", "1.5 KB/s", "1 MB/s", "0 B/s", "0.2 B/s"]


@pytest.mark.parametrize(
    ("low", "high", "confidence", "text"),
    [(None, None, 0.9, "~5m"), (290.0, 310.0, 0.9, "~5m"), (180.0, 420.0, 0.9, "3m - 7m"), (180.0, 420.0, 0.5, "3m - 7m"), (None, None, 0.5, "~5m (rough)"), (180.0, 420.0, 0.2, "~5m (rough)"), (None, None, 0.05, "~5m (very rough)")],
)
def test_eta_text_with_and_without_bounds(spark, low, high, confidence, text):
    d = spark.createDataFrame([(300.0, low, high, confidence)], "s double, l double, u double, c double")
    assert d.select(S.eta_text(*[F.col(c) for c in "sluc"])).first()[0] == text


def test_small_helpers(spark):
    texts = ["3", " 4 ", "0", "-1", "x", None]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in d.select(S.positive_int(F.col("t"))).collect()] == [3, 4, None, None, None, None]
    assert [r[0] for r in d.select(S.non_negative_int(F.col("t"))).collect()] == [3, 4, 0, None, None, None]
    m = spark.createDataFrame([({"a": "1", "_b": "2", "c": "<x object at 0x1>"},), ({"_x": "1"},)], "m map<string,string>")
    assert [r[0] for r in m.select(S.normalised(F.col("m"))).collect()] == [{"a": "1"}, None]
    assert one(spark, S.wildcard_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), s=1) == "a=1, b=2"
    assert one(spark, S.count_text(F.col("s"), F.lit(0)), s=3) == "3 of 0"
