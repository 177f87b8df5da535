"""Chunks with overlap: limits, offsets, and the text put together again."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import recursive_chunk as C

texts = st.lists(st.sampled_from(["a", "bb", "ccc. ", ", ", " ", "\n", "\n\n", "x! ", "é", "\n \n", "Chapter 1 x\n", "😀 "]), max_size=120).map("".join)


def check(text, size, overlap, how):
    starts, ends = C.unit_spans(text, how)
    got = C.chunks(text, size, overlap, how)
    if not len(starts):
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(starts) and got[0][2] == 0
    for (a, b, _), (c, d, shared) in zip(got, got[1:]):
        assert a < c <= b < d and shared == b - c <= overlap
    assert all(0 < b - a <= size for a, b, _ in got)
    whole, at = "", None
    for a, b, shared in got:  # without what it shares, each chunk follows the one before
        x = int(starts[a + shared])
        whole += (text[at:x] if at is not None else "") + text[x: int(ends[b - 1])]
        at = int(ends[b - 1])
    assert whole == text[int(starts[0]): int(ends[-1])]


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 11), st.sampled_from([C.WORDS, C.CHARACTERS]))
def test_cover_limit_and_overlap(text, size, overlap, how):
    check(text, size, min(overlap, size - 1), how)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 12))
def test_atoms_partition_the_units(text, size):
    starts, _ = C.unit_spans(text)
    got = C.atoms(text, starts, size)
    assert [x for a, b in got for x in range(a, b)] == list(range(len(starts))) and all(b - a <= size for a, b in got)


def test_strong_separators_win():
    text = "one two three.\n\nfour five. six seven eight nine.\n\nten"
    got = [text[s: e] for s, e in ((int(C.unit_spans(text)[0][a]), int(C.unit_spans(text)[1][b - 1])) for a, b, _ in C.chunks(text, 5, 0))]
    assert got == ["one two three.\n\nfour five.", "six seven eight nine.\n\nten"]
    assert [c for c in C.chunks("a b c d e f g", 3, 1)] == [(0, 3, 0), (2, 5, 1), (4, 7, 1)]
    assert C.chunks("x" * 10, 4, 2, C.CHARACTERS) == [(0, 4, 0), (2, 6, 2), (4, 8, 2), (6, 10, 2)]


def test_frame(spark):
    text = "Intro here.\n\nChapter 1 Start\nfirst words of it.\n\nmore of it\n\nCHAPTER two\nlast"
    rows = [(1, text, "x"), (2, None, "y"), (3, " \n ", "z"), (None, "one", None), (None, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Chunk string")
    got = C.recursive_chunks(df, size=6, overlap=2).collect()
    assert got[0].asDict().keys() == {"doc_id", *C.ADDED}
    one = [r for r in got if r["doc_id"] == 1]
    assert all(text[r["start"]: r["end"]] == r["chunk"] and len(r["chunk"].split()) == r["n_units"] for r in one)
    assert one[0]["chapter"] is None and one[-1]["chapter"] == "Chapter 1 Start" and [r["chunk_idx"] for r in one] == list(range(len(one)))
    assert one[0]["paragraph"] == 0 and one[-1]["paragraph"] == max(r["paragraph"] for r in one) > 0
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 0, 0, 3, 1, 0, None, 0, "one")] * 2
    assert C.recursive_chunks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.recursive_chunks(df, size=5, overlap=5)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 200_000)], "id long, text string")
    got = C.recursive_chunks(df).agg({"chunk_idx": "max", "n_units": "max", "n_overlap": "max"}).first()
    assert tuple(sorted(got)) == (100, 499, 500)
