"""The tables that op12 writes of whole texts are packed tighter than the session's own."""

from pathlib import Path

from shiftscope.llm import repeats


def test_texts_are_packed(spark, monkeypatch):
    own, packed = repeats.written, {}

    def spy(df, name, *how):
        table = own(df, name, *how)
        packed[name] = all(".zstd." in p.name for p in Path(table._shiftscope_path.removeprefix("file:")).glob("*.parquet"))
        return table

    monkeypatch.setattr(repeats, "written", spy)
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r["__rep_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: 50, 2: 50, 3: 0}
    assert packed["repeat-texts"] and packed["repeat-found"]
