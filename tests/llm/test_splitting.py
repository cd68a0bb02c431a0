import random

import pytest

from cairnset.llm import splitting as S

rng = random.Random(4)
WORDS = [["lease", "quota", "cache", "shard"], ["walker", "token", "parser", "symbol"]]
TOPICS = "\n".join(" ".join(rng.choice(WORDS[i // 12 % 2]) for _ in range(8)) for i in range(120))
TEXTS = {
    "topics": TOPICS, "one line": "x" * 9000, "words": "word " * 3000, "crlf": "ab cd\r\n" * 2000, "wide": "漢字かな。" * 3000,
    "marks": ("é" * 5000), "emoji": "\U0001f469‍\U0001f4bb" * 4000, "blank": " " * 5000, "newlines": "\n" * 5000,
    "slabs": ("some words here. " * 20 + "\n") * 1500}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("limit", [(2048, 256), (100, 0), (64, 63)])
def test_pieces_cover_the_text_within_the_limit(name, limit):
    text, (size, overlap) = TEXTS[name], limit
    if size == 64:
        text = text[:3000]
    spans = S.spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - overlap == c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text


def test_cuts_at_topic_changes_and_lines():
    cuts = [b for _, b in S.spans(TOPICS, 1500, 0)][:-1]
    lines = [TOPICS.count("\n", 0, c) for c in cuts]
    assert all(TOPICS[c - 1] == "\n" for c in cuts)
    assert sum(n % 12 == 0 for n in lines) >= 0.7 * len(lines)


def test_no_mark_or_joined_sequence_is_parted():
    for name in ("marks", "emoji"):
        for _, b in S.spans(TEXTS[name], 2000, 100)[:-1]:
            assert TEXTS[name][b] not in "́‍" and TEXTS[name][b - 1] != "‍"


def test_spark_nulls_repeats_and_extra_columns(spark):
    long = "line of words\n" * 40
    rows = [("c1", 1, 0, long, "x"), ("c1", 1, 0, long, "x"), ("c2", 1, 1, None, "y"), (None, 2, 0, long, "z"), ("c3", None, 0, "", "p")]
    df = spark.createDataFrame(rows, "chunk_id string, file_id long, seq int, content string, piece string")
    out = S.split_oversized(df, 100, 10).collect()
    assert {(r.chunk_id, r.file_id) for r in out} == {("c1", 1), (None, 2)}
    one = sorted((r.piece_no, r.start, r.piece) for r in out if r.chunk_id == "c1")
    assert [p[0] for p in one] == list(range(one[-1][0] + 1)) and all(long[s:s + len(t)] == t for _, s, t in one)
    assert S.split_oversized(df.limit(0), 100, 10).count() == 0


def test_overlap_must_be_smaller_than_the_limit():
    with pytest.raises(ValueError):
        S.spans("abc", 2, 2)
