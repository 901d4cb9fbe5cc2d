import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from webfurrow.functions import fingerprint as fp


def model(text):
    words = re.split(r"[^A-Za-z0-9_]+", text)
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
    bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def test_tokens(value):
    assert value(fp.tokens(F.lit(" a,b  è_c. "))) == ["", "a", "b", "_c", ""]
    assert value(fp.tokens(F.lit(""))) == [""]


def test_simhash(spark):
    rng = random.Random(2)
    texts = ["", "a", "a a b", "...", "x" * 500]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (2, 126, 127, 128, 254, 255, 1000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.simhash(F.col("t")).alias("h")).collect()
    for r in got:
        assert r.h == model(r.t)


def test_simhash_of_a_long_text_counts_every_token(spark):
    text = "same " * 70000 + "other"
    df = spark.createDataFrame([(text,)], "t string").select(fp.simhash(F.col("t")).alias("h"))
    assert df.first().h == model(text)


@pytest.mark.parametrize("step,changed", [(0, False), (2, False), (3, True)])
def test_change_threshold(value, step, changed):
    assert value(fp.is_changed(F.lit(0x5A5A ^ ((1 << step) - 1)), F.lit(0x5A5A))) is changed


def test_unknown_page_is_changed(value):
    assert value(fp.is_changed(F.lit(1), F.lit(None).cast("bigint")))
    assert value(fp.distance(F.lit(0x5A5A), F.lit(0x5A59))) == 2
    assert value(fp.distance(F.lit(-1), F.lit(0))) == 64
