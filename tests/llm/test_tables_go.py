from pathlib import Path

from clickstrata.llm import jaccard, lines
from clickstrata.sources.folders import shared_dir


def columns_left(spark, make):
    """Columns of the intermediate tables that are still there when the result is read."""
    home = Path(shared_dir(spark).removeprefix("file://"))
    before = set(home.glob("stage-*"))
    rows = sorted(make().collect(), key=repr)
    return rows, {c for folder in set(home.glob("stage-*")) - before for c in spark.read.parquet(str(folder)).columns}


def test_prefixes_sets_and_keys_of_lines_are_not_kept(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} more"), (3, "others"), (4, None)], "doc_id long, text string")
    rows, left = columns_left(spark, lambda: jaccard.join(docs, also=docs).select("doc_id", "component_id", "layer"))
    assert rows == sorted([(i, 1 if i == 2 else i, layer) for i in (1, 2, 3, 4) for layer in (0, 1)], key=repr)
    assert not left & {"prefix", "parity", "shingle", "shingles"}
    rows, left = columns_left(spark, lambda: lines.decisions(docs).select("doc_id", "gone"))
    assert not left & {"k", "of"}


def test_line_dedup_leaves_its_decisions_only(spark, monkeypatch):
    monkeypatch.setattr(lines, "GROUP", 2)
    line = "a line that is long enough to be compared with others of its kind"
    rows = [(i, f"{line[:i]}{'xyz'[i % 3]}{line[i + 1 :]}\nown words of number {i}") for i in range(2, 12)]
    docs = spark.createDataFrame([*rows, (20, line), (21, line), (22, None)], "doc_id long, text string")
    for edits in (1, 2):
        found, left = columns_left(spark, lambda: lines.decisions(docs, edits).select("doc_id", "gone"))
        assert {r.doc_id for r in found} >= {20, 21} and left == {"doc_id", "hash", "gone"}
