"""Tables of small files go on together."""

from __future__ import annotations

import pyarrow as pa

from docloom.sources import tabular


def test_small_files_go_on_together(spark, monkeypatch):
    class Files:
        schema = spark.createDataFrame([], "source_identifier string, content binary").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    files = Files()
    tabular.read_csv_tables(files)
    contents = [None if k % 7 == 0 else b"" if k % 7 == 1 else f"a;b\n{k};\"x;y\"\nz\n".encode() for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(300)]), pa.array(contents, pa.binary())], ["source_identifier", "content"])

    def check(most):
        out = list(files.run(iter([batch])))
        assert len(out) == most
        rows = [r for b in out for r in b.to_pylist()]
        assert [r["source_identifier"] for r in rows] == [str(k) for k in range(300)]
        for r, c in zip(rows, contents):
            want = None if c is None else [{"row_type": "body", "values": [{"val": v, "colspan": 1} for v in line]} for line in tabular.parse(c)]
            assert r["rows"] == want

    check(1)
    monkeypatch.setattr(tabular, "TOGETHER", 0)
    check(sum(1 for c in contents if c) + 0 if contents[-1] else -1)
