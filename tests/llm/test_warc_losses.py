"""Records lost and put in inside files."""

from __future__ import annotations

from docloom.llm import warc
from docloom.llm.queries import damaged, incomplete, op7_warc_losses

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def states(df):
    return sorted((r.page_id, r.state) for r in df.collect())


def test_a_record_lost_from_the_middle(spark):
    rows = [(i, f"u{i}", "x" * (10 + i)) for i in range(20)]
    a, b = pages(spark, rows), pages(spark, rows[:7] + rows[8:])
    behind = [(i, "moved") for i in range(8, 20)]
    assert states(warc.audit(a, b)) == [(7, "missing"), *behind]
    assert states(warc.audit(b, a)) == [(7, "extra"), *behind]
    # offsets are those of the first replica
    end = 0
    for r in sorted(warc.audit(a, b).collect(), key=lambda r: r.page_id):
        assert r.start_offset >= end and r.end_offset > r.start_offset
        end = r.end_offset


def test_repeated_ids_are_paired_by_digest(spark):
    rows = [(1, "u", "a"), (2, "u", "first"), (2, "u", "second"), (2, "u", "second"), (3, "u", "c")]
    a = pages(spark, rows)
    got = states(warc.audit(a, pages(spark, [rows[0], rows[1], rows[2], rows[4]])))
    assert [x for x in got if x[1] != "moved"] == [(2, "missing")]
    got = states(warc.audit(a, pages(spark, [rows[0], (2, "u", "other"), rows[2], rows[3], rows[4]])))
    assert [x for x in got if x[1] != "moved"] == [(2, "changed")]


def test_the_query_by_hand(spark, data_dir):
    p = spark.read.parquet(f"{data_dir}/pages.parquet").select("page_id", "url", "html")

    def held(df):
        return {(r._page, r._digest): (r._file, r._start, r._end) for r in warc.records(df).collect()}

    a, b = held(p), held(incomplete(p))
    lost = {k for k in {k for k, _ in a} if k % 61 == 41}
    again = {k for k in {k for k, _ in a} if k % 83 == 29}
    want = {(*a[k], k[0], "moved") for k in a.keys() & b.keys() if a[k] != b[k]}
    ra, rb = a.keys() - b.keys(), b.keys() - a.keys()
    changed = {r.page_id for r in p.join(damaged(p).withColumnRenamed("html", "h"), "page_id").where("html <> h").collect()} - lost
    want |= {(*a[k], k[0], "missing" if k[0] in lost else "changed") for k in ra}
    want |= {(*b[k], k[0], "extra") for k in rb if k[0] in again and k[0] not in changed}
    got = {(r.warc_file, r.start_offset, r.end_offset, r.page_id, r.state) for r in op7_warc_losses(spark, data_dir).collect()}
    assert lost and again and not again & changed and got == want
