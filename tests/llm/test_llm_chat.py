import hashlib
import random
import re

from pyspark.sql import functions as F
from runlens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def texts(n):
    rng = random.Random(3)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "\\", "\\\\", "<", "[", "<\\/s>", "[\\\\INST]", "<<SYS>>", "ok", "\n", "é\U0001F642", "|im_end|>", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_round_trip_with_control_strings(spark):
    ts, rng = texts(400), random.Random(4)
    rows = [(i // 8, i % 8, rng.choice(["user", "assistant", "system", "a\\nb\n", ""]), t) for i, t in enumerate(ts)]
    form = C.formatted(frame(spark, rows))
    got = {r.conv_id: r for r in C.read_back(form).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3]) for r in mine]
        assert got[c].loss == "".join(r[3] for r in mine if r[2] == "assistant")
        assert got[c].formatted.count(C.END) == len(mine) and got[c].formatted.count(C.START) == len(mine)
        assert "</s>" not in got[c].formatted and "[INST]" not in got[c].formatted


def test_an_example_is_a_prefix_with_only_the_reply_masked(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "alone")]
    form = C.formatted(frame(spark, rows))
    got = sorted((r.conv_id, r.example, r.input, r.input[r.loss_start:r.loss_end]) for r in C.materialise(form).collect())
    assert [(g[0], g[1], g[3]) for g in got] == [(1, 0, "a1"), (1, 1, "a2")]
    assert got[0][2].endswith("a1") and "q2" not in got[0][2] and "a1" in got[1][2] and "q3" not in got[1][2]
    assert C.examples(form).count() == 2


def test_the_query_goes_through_its_examples(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), x) for c in (1, 2, None) for t, x in enumerate(texts(120))] + [(3, 0, "user", "alone")]
    form = C.formatted(frame(spark, rows))
    made = sorted(C.materialise(form).collect(), key=lambda r: (str(r.conv_id), r.example))
    want = [(str(c), x) for c in (1, 2, None) for k, t, role, x in rows if k == c and role == "assistant"]
    assert [(str(r.conv_id), r.input[r.loss_start:r.loss_end]) for r in made] == [(c, escaped(x)) for c, x in want]
    spans = lambda df: sorted((str(r.conv_id), r.example, r.loss_start, r.loss_end) for r in df.collect())
    assert spans(C.examples(form)) == spans(C.materialise(form))
    whole = lambda df: sorted((str(r.conv_id), r.formatted, [tuple(s) for s in r.targets]) for r in df.collect())
    assert whole(C.gathered(C.expanded(form))) == whole(form)

    sf = "/root/testdata/sf0.001"
    before = {r.conv_id: r.loss_chars for r in C.query(spark, sf).collect()}
    plain = C.expanded
    monkeypatch.setattr(C, "expanded", lambda f: plain(f).where("example IS NULL OR example = 0"))
    after = {r.conv_id: r.loss_chars for r in C.query(spark, sf).collect()}
    assert before.keys() == after.keys() and any(after[c] < before[c] for c in before)  # a missed example shows


def test_the_query_reads_the_inputs_of_its_examples(spark, monkeypatch):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "alone")]
    got = {(r.conv_id, r.example): r for r in C.expanded(C.formatted(frame(spark, rows))).collect()}
    first, second, alone = got[1, 0], got[1, 1], got[2, None]
    assert second.input.startswith(first.input) and first.input.endswith("a1") and second.input.endswith("a2") and "q3" in second.rest
    assert first.rest is None and alone.input is None and "alone" in alone.rest
    gathered = {r.conv_id: r for r in C.gathered(C.expanded(C.formatted(frame(spark, rows)))).collect()}
    assert gathered[1].replies == ["a1", "a2"] and gathered[2].replies == []

    sf = "/root/testdata/sf0.001"
    before = {r.conv_id: r for r in C.query(spark, sf).collect()}
    plain = C.expanded
    monkeypatch.setattr(C, "expanded", lambda f: plain(f).withColumn("input", F.replace("input", F.lit("a"), F.lit("?"))))
    after = {r.conv_id: r for r in C.query(spark, sf).collect()}
    assert any(after[c].loss_sha256 != r.loss_sha256 for c, r in before.items()) and any(after[c].turns_sha256 != r.turns_sha256 for c, r in before.items())


def escaped(x):
    return re.sub(r"([<\[])(\\*)(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>)", r"\1\\\2", x)


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (None, 0, "user", "x"), (1, 0, "user", "a")]
    got = {r.conv_id: r for r in C.read_back(C.formatted(frame(spark, rows))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "x")]
    assert C.read_back(C.formatted(frame(spark, rows).where("false"))).count() == 0


def test_query_reads_the_probe_back(spark):
    r = C.query(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
