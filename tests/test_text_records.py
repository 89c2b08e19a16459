import os

from textcluster.operators import parse as ps
from textcluster.sources.text import read_text_records

FILE = (
    "1. J Foo. 2017.\n\nTitle one.\n\nAuth A.\n\nAuthor information: X\n\nAbstract one text.\n\n"
    "PMID: 28111111  [Indexed]\n\n\n"
    "2. J Bar. 2017.\n\n\nTitle two.\n\nAuth B.\n\nAuthor information: Y\n\nAbstract two.\n\n"
    "PMID: 2811112  [Indexed]\n\n"
    "3. J Baz.\n\nShort.\n\nPMID: 28111113\n\n"
    "4. J Qux. 2017.\n\nTitle four.\n\nAuth.\n\nInfo.\n\nAbstract four.\n\nPMID: 28111114"
)


def test_records_and_fields(spark, tmp_dir):
    os.makedirs(tmp_dir, exist_ok=True)
    with open(f"{tmp_dir}/a.txt", "w", encoding="utf-8") as f:
        f.write(FILE + "\ntrailing text without id\n")
    with open(f"{tmp_dir}/one.txt", "w", encoding="utf-8") as f:
        f.write("1. J.\n\nT.\n\nA.\n\nI.\n\nAbs.\n\nPMID: 12345678\n")
    recs = read_text_records(spark, tmp_dir)
    rows = {(os.path.basename(r["source_file"]), r["seq"]): r for r in ps.parse_text(recs).collect()}
    assert len(rows) == 5
    r0 = rows[("a.txt", 0)]
    assert (r0["title"], r0["content"], r0["permalink"]) == ("Title one.", "Abstract one text.", "28111111")
    r1 = rows[("a.txt", 1)]
    assert (r1["title"], r1["content"], r1["permalink"]) == ("Title two.", "Abstract two.", None)  # 7-digit id
    r2 = rows[("a.txt", 2)]
    assert (r2["title"], r2["content"], r2["permalink"], r2["error"]) == (None, None, None, "too_few_segments")
    r3 = rows[("a.txt", 3)]
    assert (r3["content"], r3["permalink"]) == ("Abstract four.", "28111114")  # id line without newline
    assert rows[("one.txt", 0)]["permalink"] == "12345678"


def test_line_based_records_equal_whole_file_records(spark, tmp_dir):
    from textcluster.sources.text import read_text_records_by_lines

    os.makedirs(tmp_dir, exist_ok=True)
    with open(f"{tmp_dir}/a.txt", "w", encoding="utf-8") as f:
        f.write(FILE + "\ntrailing text without id\n")
    whole = {(r["seq"], r["record"].strip("\n")) for r in read_text_records(spark, tmp_dir).collect()}
    # Tiny splits force one file over many tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        by_lines = {(r["seq"], r["record"].strip("\n")) for r in read_text_records_by_lines(spark, tmp_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert by_lines == whole and len(whole) == 4


def test_line_based_records_many_small_files_and_small_batches(spark, tmp_dir):
    from textcluster.sources.text import read_text_records_by_lines

    os.makedirs(tmp_dir, exist_ok=True)
    for i in range(4):
        with open(f"{tmp_dir}/f{i}.txt", "w", encoding="utf-8") as f:
            f.write(FILE.replace("2811", f"{i}811"))
    whole = {(r["source_file"], r["seq"], r["record"].strip("\n")) for r in read_text_records(spark, tmp_dir).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {
            (r["source_file"], r["seq"], r["record"].strip("\n"))
            for r in read_text_records_by_lines(spark, tmp_dir).collect()
        }
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == whole and len(whole) == 16
