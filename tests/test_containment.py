"""The k-gram containment join equals a brute-force first-match scan."""

import contextlib
import io
import random
import re

import pyref
from runlens.operators import containment
from runlens.operators.containment import extract_label


def _check(spark, texts, classes):
    tdf = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cdf = spark.createDataFrame([(i * 10, c) for i, c in enumerate(classes)], "pos bigint, label string")
    got = {r.doc_id: (r.label, r.pass_) for r in
           extract_label(tdf, cdf, ["doc_id"]).withColumnRenamed("pass", "pass_").collect()}
    for i, t in enumerate(texts):
        want = pyref.extract_label(t, classes)
        assert got[i] == want, (t, classes, got[i], want)


def test_law_style_classes(spark):
    classes = ["盗窃", "诈骗", "故意伤害", "盗窃罪", "抢劫", "非法经营"]
    texts = ["被告人实施了盗窃罪行", "罪名：诈骗", "[罪名]抢劫罪", "无关文本", "  故意伤害他人  ", "非法经营罪名",
             "", "罪"]
    _check(spark, texts, classes)


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "ab c罪\n"
    classes = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 6))) for _ in range(12)] + [" ab ", "罪 "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    _check(spark, texts, classes)


def test_long_classes_and_empty_class(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", " ", "\n"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(5, 400))) for _ in range(40)]
    classes = [texts[5][10:50], texts[9][0:40], "gammadeltagammadeltaalphabeta alpha beta", texts[20][-35:]]
    _check(spark, texts, classes)
    _check(spark, texts[:5], classes + [""])


def test_supplementary_characters(spark):
    rnd = random.Random(11)
    alphabet = "ab😀é 𝔸"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(40)]
    classes = [texts[3][5:30] or "ab", "😀😀a", texts[7][:18] or "b😀", "𝔸é𝔸", "zzz"]
    _check(spark, texts, classes)


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_no_exchange_carries_text(spark):
    """Only keys, passes and positions leave a task; texts and chunks never do."""
    texts = spark.createDataFrame([(i, f"some text {i} with a passage of words {i}") for i in range(50)], "doc_id int, text string")
    classes = spark.createDataFrame([(0, "a passage of words 7"), (1, "passage of")], "pos bigint, label string")
    lines = _plan(extract_label(texts, classes, ["doc_id"])).splitlines()
    for i, line in enumerate(lines):
        if " Exchange " in line:
            below = lines[i + 1]
            assert "doc_id" in below and not re.search(r"\b(t|t1|c|text|chunk|pattern)#", below), below


def test_postings_beyond_the_byte_bound(spark, monkeypatch):
    """Class texts that may not be broadcast: the same result through postings."""
    monkeypatch.setattr(containment, "MAX_BYTES", 100)
    rnd = random.Random(5)
    alphabet = "ab c罪\n"
    classes = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 40))) for _ in range(15)] + ["罪 "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    texts += [classes[3] + "x" + classes[9], classes[12]]
    _check(spark, texts, classes)


def test_stride_shrinks_until_anchors_fit():
    stats = {"m": 200, "rows": 1000}
    k, stride = containment.grams(stats, 64 << 20)
    assert (k, stride) == (16, 64)
    k, stride = containment.grams(stats, 1 << 20)
    assert stride == 16 and stride * 1000 * containment.ANCHOR_BYTES <= 1 << 20
    assert containment.grams(stats, 10)[1] == 1 and containment.grams({"m": 3, "rows": 5}, 64 << 20) == (3, 1)
