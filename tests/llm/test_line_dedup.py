import pytest

from siltstone.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) > 1 and min(h) != (float("inf") if i is None else i) for x in lines]
        text = t if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, text, len(lines), sum(gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("way", [dict(), dict(broadcast_bytes=0), dict(shard_keys=2), dict(broadcast_bytes=0, shard_keys=2)])
def test_odd_rows(odd, texts, way):
    out = line_dedup.line_dedup(odd, **way)
    assert set(out.columns) == set(odd.columns) | {"n_dropped"}
    assert rows_of(out) == brute(texts)


@pytest.mark.parametrize("way", [dict(), dict(broadcast_bytes=0, shard_keys=40)])
def test_documents(spark, sf, way, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert rows_of(line_dedup.line_dedup(docs, **way)) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("way", [dict(), dict(broadcast_bytes=0), dict(broadcast_bytes=0, shard_keys=2)])
def test_rows_that_share_an_identifier(spark, way):
    texts = ["a line that is shared\nyet another line", "a unique first line here\na line that is shared", "a third row's own line\nx\nyet another line"]
    rows = [(1, "a line that is shared\nyet another line"), *((i, t) for i in (None, 7) for t in texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(line_dedup.line_dedup(df, **way)) == brute(rows)


@pytest.mark.parametrize("way", [dict(), dict(broadcast_bytes=0), dict(broadcast_bytes=0, shard_keys=3, questions=5)])
def test_hot_null_and_repeated_identifiers(spark, way, monkeypatch):
    """A third of all rows has no identifier, a third repeats one, all with texts of their own; one line is in most."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 2)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"the line that most of them hold\nline of a pair number {k // 2}\na line of its own, {k}\nx") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(line_dedup.line_dedup(df, **way)) == brute(rows)


def test_empty_table(none):
    assert line_dedup.line_dedup(none).count() == 0
    assert line_dedup.line_dedup(none, broadcast_bytes=0).count() == 0
