import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import splitting


def check_pieces(rows, source, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows))) and rows[0].start_at == 0 and rows[-1].end_at == len(source)
    for r in rows:
        assert source[r.start_at : r.end_at] == r.piece and 0 < len(r.piece) <= limit
    for a, b in zip(rows, rows[1:]):
        assert 0 <= a.end_at - b.start_at <= overlap and b.start_at > a.start_at


def sentence(rng):
    return " ".join(rng.choice(["Straße", "museum", "日本語", "river", "naïve"]) for _ in range(rng.randint(3, 15))).capitalize() + rng.choice([". ", "! ", ".\n\n", ".\r\n", "”。", ".”) "])


def test_split_round_trip(spark):
    rng = random.Random(9)
    texts = {1: "".join(sentence(rng) for _ in range(300)), 2: "x" * 5000, 3: "small", 4: "a. " * 4000, 5: "語" * 3000, 6: " " * 900}
    rows = [(i, t, 0) for i, t in texts.items()] + [(1, texts[1], 0), (7, None, 0), (8, "", 0), (None, "y" * 999, 0)]
    df = spark.createDataFrame(rows, "Id long, Doc string, item int")
    found = []
    for size, block in ((1 << 20, 3000), (700, 3000), (1 << 20, None)):
        got = splitting.split_texts(df, "Id", "Doc", 400, 60, range_bytes=size, block=block).collect()
        assert {r.id for r in got} == {1, 2, 4, 5, 6}
        for i in (1, 2, 4, 5, 6):
            check_pieces([r for r in got if r.id == i], texts[i], 400, 60)
        found.append(sorted((r.id, r.piece_no, r.start_at, r.end_at) for r in got))
    assert found[0] == found[1]
    ends = [r.piece.rstrip()[-1] for r in got if r.id == 1]
    assert sum(e in ".!。)" for e in ends) >= 0.95 * len(ends)
    assert splitting.split_texts(df.limit(0), "Id", "Doc", 400, 60).count() == 0


@pytest.mark.parametrize("size", [64, 500, 1024, 4097])
def test_split_ranges_do_not_matter(spark, size):
    rng = random.Random(3)
    t = ("Heading here\n\n" + "One sentence stands here. Another follows it! " * 30 + "\n\n") * 6 + "".join(sentence(rng) for _ in range(200)) + "\n" * 3000 + "word " * 900 + "A heading of its own" + " " * 2000 + "\n\n" + "x. " * 300
    df = spark.createDataFrame([(1, t)], "Id long, Doc string")
    a, b = ([(r.start_at, r.end_at) for r in sorted(splitting.split_texts(df, "Id", "Doc", 500, 80, range_bytes=s, block=4000).collect(), key=lambda r: r.piece_no)] for s in (1 << 20, size))
    assert a == b


def test_split_files(spark, tmp_path):
    t = "Erster Satz über Käse. Zweiter Satz! 日本語の文。" * 500
    p = tmp_path / "big.txt"
    p.write_text(t, encoding="utf-8")
    (tmp_path / "none.txt").write_text("")
    got = splitting.split_files(spark, [str(p), str(tmp_path / "none.txt")], 300, 40, range_bytes=2000, block=5000).collect()
    assert {r.item for r in got} == {0}
    check_pieces(got, t, 300, 40)
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_texts(spark.createDataFrame([], "Id long, Doc string"), "Id", "Doc", 10, 10)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. !\n語é。”", max_size=300), st.integers(5, 40), st.integers(50, 200))
def test_cut(t, limit, block):
    out = splitting.cut(t, limit, limit // 4, block)
    assert "".join(t[a:b] if not i else t[max(a, out[i - 1][1]) : b] for i, (a, b) in enumerate(out)) == t
    assert all(0 < b - a <= limit for a, b in out)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. !\n語é。”\t=", max_size=200), st.integers(1, 60))
def test_boundaries_of_ranges_are_those_of_the_whole(t, body):
    raw = t.encode()
    p, s = splitting.boundaries(t, 0, len(t))
    got, base = [], 0
    for at in range(0, len(raw), body):
        left, data = splitting.with_halo(lambda x, n: raw[x : x + n], at, min(body, len(raw) - at), len(raw))
        z, a, b = splitting._aligned(data, 0) if at > left else 0, splitting._aligned(data, left), splitting._aligned(data, left + min(body, len(raw) - at))
        before, own, after = data[z:a].decode(), data[a:b].decode(), data[b:].decode("utf-8", "ignore")
        q, v = splitting.boundaries(before + own + after, len(before), len(before) + len(own), at - left + z)
        got += [(int(x) - len(before) + base, int(y)) for x, y in zip(q, v)]
        base += len(own)
    assert got == list(zip(p.tolist(), s.tolist()))


@pytest.mark.parametrize("unit", [".", "\n", " ", "。", "a. ", "=", ") ", "x"])
def test_linear_time(unit):
    took = []
    for n in (500_000, 2_000_000):
        text = unit * (n // len(unit)) + "end"
        began = time.monotonic()
        splitting.cut(text, 2000, 100, 1 << 20)
        took.append(time.monotonic() - began)
    assert took[1] < 8 * took[0] + 1
