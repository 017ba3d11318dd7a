"""Chunker (T2) against an independent Python oracle, plus properties."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tabsieve.operators.chunk import chunk_documents, chunk_spans

DELIMS = [". ", ".\n", "! ", "!\n", "? ", "?\n"]


def oracle_chunks(text, size=1000, overlap=200):
    """Straightforward re-statement of the reference behaviour with the
    no-progress guard (hard cut at start + size)."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            snapped = None
            for d in DELIMS:
                pos = text[start:end].rfind(d)
                if pos != -1:
                    snapped = start + pos + len(d)
                    break
            if snapped is not None and snapped - overlap > start:
                end = snapped
        out.append(text[start:end].strip())
        start = end - overlap
        if start >= len(text):
            break
    return out


def test_spark_chunker_matches_python_oracle(spark, tables_mid):
    docs = tables_mid.documents.select("doc_id", "text")
    got = {}
    for r in chunk_documents(docs, ["doc_id"], "text").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"]))
    for r in docs.collect():
        expect = oracle_chunks(r["text"])
        have = [t for _, t in sorted(got[r["doc_id"]])]
        assert have == expect, r["doc_id"]


def test_astral_characters_count_as_one():
    text = ("\U0001F600 abc. " * 150)
    spans = chunk_spans(text)
    assert [text[s:e].strip() for s, e in spans] == oracle_chunks(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?\n")), min_size=0, max_size=4000),
       st.integers(min_value=50, max_value=600))
def test_spans_cover_and_progress(text, size):
    overlap = size // 5
    spans = chunk_spans(text, size, overlap)
    assert spans[0][0] == 0
    assert all(b[0] > a[0] for a, b in zip(spans, spans[1:]))   # always advances
    assert spans[-1][1] >= len(text)                           # reaches the end
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))  # no gaps
    assert [text[s:e].strip() for s, e in spans] == oracle_chunks(text, size, overlap) or len(text) <= size


def test_drop_suffix_tail():
    text = "x" * 1000 + ". " + "y" * 150
    keep = chunk_spans(text)
    drop = chunk_spans(text, drop_suffix_tail=True)
    assert len(drop) <= len(keep)
    assert drop[-1][1] >= len(text)


def test_min_chars_in_chunker_equals_min_content_filter(tables_mid):
    from tabsieve.operators.chunk import chunk_documents
    from tabsieve.operators.filters import min_content
    from tabsieve.plans.corpus import page_text

    pt = page_text(tables_mid)
    lengths = sorted(len(r["text"].strip()) for r in pt.select("text").collect() if r["text"] is not None)
    for threshold in (100, lengths[len(lengths) // 2]):
        kept, rejected = min_content(pt, "text", threshold)
        a = chunk_documents(kept, ["page_id"], "text", 1000, 200)
        b = chunk_documents(pt, ["page_id"], "text", 1000, 200, min_chars=threshold)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert rejected.count() > 0 and kept.count() > 0
