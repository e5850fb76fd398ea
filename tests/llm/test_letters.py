import random
import string

import pytest
from pyspark.sql import functions as F

from presswork.llm import secret_scan

#: Least share found of random keys without digits; 300 of each kind.
PLANTED = [
    (string.ascii_letters, 20, 0.93),
    (string.ascii_letters, 32, 0.98),
    (string.ascii_letters + "+/", 40, 0.98),
    (string.ascii_lowercase, 20, 0.65),
    (string.ascii_lowercase, 32, 0.92),
    (string.ascii_uppercase, 40, 0.95),
]
WORDS = ["internationalization", "a/path/to/some/other/place", "use_of_a_longer_identifier", "getMoreInterestingArticles", "Unabhaengigkeitserklaerung", "-" * 40]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(11)
    rows = [(k, "see " + "".join(rng.choices(signs, k=n)) + " there") for k, (signs, n, _) in enumerate(PLANTED) for _ in range(300)]
    rows += [(100 + k, f"see {w} there") for k, w in enumerate(WORDS)]
    df = spark.createDataFrame(rows, "kind int, text string")
    scanned = secret_scan.scan(df)
    masked = F.col("text").contains("[SECRET]").cast("int")
    spans = {r.kind: r.share for r in scanned.groupBy("kind").agg(F.avg((F.size("spans") > 0).cast("int")).alias("share")).collect()}
    return spans, {r.kind: r.share for r in secret_scan.mask(scanned).groupBy("kind").agg(F.avg(masked).alias("share")).collect()}


def test_letters_only_keys_are_found_and_masked(found):
    spans, masked = found
    assert spans == masked
    assert all(spans[k] >= least for k, (_, _, least) in enumerate(PLANTED))


def test_words_and_paths_are_not(found):
    assert [w for k, w in enumerate(WORDS) if found[0][100 + k]] == []
