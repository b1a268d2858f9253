import codecs
import csv
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from colsift import AuditError, IntakeConfig, TableProfile, audit_csv
from colsift.functions.stage import stage_columns
from colsift.operators import checks as C
from colsift.sources import csv as X
from colsift.sources import folder, records, sinks, streams


@pytest.fixture
def file(tmp_path):
    def write(content, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)
    return write


def code_of(spark, path, config=IntakeConfig()):
    with pytest.raises(AuditError) as e:
        X.scan_csv(spark, path, config)
    return e.value.code


@pytest.mark.parametrize("content, name, code", [
    ("a,b\n1,2\n", "t.txt", "invalid_extension"), ("", "t.csv", "empty_file"), (" \n \n", "t.csv", "empty_file"),
    (b"a,b\n1,\x002\n", "t.csv", "binary_content"), ("name, NAME\n1,2\n", "t.csv", "duplicate_columns"),
    ("a,b\n", "t.csv", "no_data_rows"), ("a,b\n,NA\nnull,\n", "t.csv", "all_rows_empty"), ("a,b\n1,2,3\n", "t.csv", "parser_error"),
    ("a,b\n1,2\n1,2,\n", "t.csv", "parser_error")])
def test_rejects(spark, file, content, name, code):
    assert code_of(spark, file(content, name)) == code


def test_limits(spark, file):
    path = file("a,b\n1,2\n3,4\n5,6\n")
    assert code_of(spark, path, IntakeConfig(max_rows=2)) == "too_many_rows"
    assert code_of(spark, path, IntakeConfig(max_columns=1)) == "too_many_columns"
    assert code_of(spark, path, IntakeConfig(max_bytes=5)) == "file_too_large"
    assert code_of(spark, file(b"a,b\n\xe9,2\n", "u.csv"), IntakeConfig(encodings=("utf-8",))) == "unsupported_encoding"


def test_types_missing_and_short_rows(spark, file):
    text = ("i,f,b,s,e,x,p\n1,1.5,true,a,,1d,0\n 2,inf,False,NA,null,2,1\n\n-3,NaN,TRUE,\"q \"\"r\"\", s\",N/A,3,1\n4,2\n")
    scan = X.scan_csv(spark, file(text))
    assert [f.dataType.simpleString() for f in scan.table.schema.fields[:7]] == ["bigint", "double", "boolean", "string", "double", "string", "bigint"]
    rows = [tuple(r)[:7] for r in scan.table.orderBy("_ord").collect()]
    assert rows == [(1, 1.5, True, "a", None, "1d", 0), (2, float("inf"), False, None, None, "2", 1),
                    (-3, None, True, 'q "r", s', None, "3", 1), (4, 2.0, None, None, None, None, None)]
    assert {r.code: r.n for r in scan.warnings().collect()} == {"empty_columns": 1}
    assert scan.row_count == 4


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, file, sep):
    path = file(f'a{sep}"b, c; d"{sep}e\n1{sep}"x|y,;"{sep}3\n4{sep}5{sep}6\n')
    fmt = X.detect_format(spark, path)
    assert fmt.delimiter == sep and fmt.names == ("a", "b, c; d", "e")
    assert X.scan_csv(spark, path).table.count() == 2


def test_encodings(spark, file):
    cases = {"utf8.csv": ("name\nJosé\n".encode(), "utf-8-sig"), "bom.csv": ("﻿name\nx\n".encode(), "utf-8-sig"),
             "win.csv": ("name\n“é€”\n".encode("cp1252"), "cp1252"), "lat.csv": (b"name\n\x81\xe9\n", "latin-1")}
    for name, (content, expected) in cases.items():
        path = file(content, name)
        scan = X.scan_csv(spark, path)
        assert scan.format.encoding == expected and scan.format.names == ("name",)
        want = content.decode("utf-8-sig" if expected == "utf-8-sig" else expected if expected == "cp1252" else "latin-1").split("\n")[1]
        assert scan.table.first()["name"] == want
        codes = {r.code for r in scan.warnings().collect()}
        assert ("fallback_encoding" in codes) == (expected != "utf-8-sig") and "single_column" in codes


def test_blank_names_and_unnamed(spark, file):
    scan = X.scan_csv(spark, file(",a,\n0,x,1\n1,y,2\n"))
    assert scan.table.columns[:3] == ["Unnamed: 0", "a", "Unnamed: 2"]
    assert {r.code: r.n for r in scan.warnings().collect()} == {"blank_header_names": 2, "unnamed_columns": 2}
    assert {r["column"] for r in C.data_type_warnings(TableProfile(scan.table, row_id="_ord")).collect()} == {"Unnamed: 0", "Unnamed: 2"}


def test_multi_line_cells(spark, file):
    path = file('a,b\n1,"x\ny"\n2,"z"\n')
    assert [r.b for r in X.scan_csv(spark, path, multi_line=True).table.orderBy("a").collect()] == ["x\ny", "z"]


def test_folder_of_files(spark, file, tmp_path):
    for i in range(3):
        file(f"a,b\n{i},x\n", f"part{i}.csv")
    scan = X.scan_csv(spark, str(tmp_path))
    assert sorted(r.a for r in scan.table.collect()) == [0, 1, 2]
    file("a,c\n1,2\n", "part9.csv")
    assert code_of(spark, str(tmp_path)) == "header_mismatch"


def test_fingerprints(spark, file):
    path = file("a,b\n1,2\n")
    r = X.file_fingerprint(X.read_files(spark, path)).first()
    assert r.fingerprint_sha256 == hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    assert r.file_key == hashlib.sha256(b"t.csv\0a,b\n1,2\n").hexdigest()


@pytest.mark.parametrize("text, rows", [
    ('id,city,note\n1,Rome,"first\nsecond"\n2,Oslo,ok\n', [(1, "Rome", "first\nsecond"), (2, "Oslo", "ok")]),
    ('id,note,city\n1,"a\n\nb",Rome\n2,"c ""d""",Oslo\n', [(1, "a\n\nb", "Rome"), (2, 'c "d"', "Oslo")])])
def test_quoted_line_ends_need_no_flag(spark, file, text, rows):
    scan = X.scan_csv(spark, file(text))
    assert sorted(tuple(r)[:3] for r in scan.table.collect()) == rows


def compare_facts(spark, folder, files, config):
    """Facts of streamed files, against the same rules on whole contents and against Python."""
    found = {r.path.rsplit("/", 1)[-1]: r for r in X.read_files(spark, str(folder), config).collect()}
    rows = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files.items()], "path string, length long, content binary")
    whole = {r.path: r for r in streams.content_facts(rows, config).collect()}
    assert set(found) == set(files)
    for name, content in files.items():
        r = found[name]
        assert tuple(r)[1:] == tuple(whole[name])[1:]
        assert r.fingerprint_sha256 == hashlib.sha256(content).hexdigest() and r.file_key == hashlib.sha256(name.encode() + b"\0" + content).hexdigest()
        for encoding in config.encodings:
            try:
                codecs.lookup(encoding)
                text = content.removeprefix(b"\xef\xbb\xbf").decode(encoding).removeprefix("\ufeff")
            except (UnicodeDecodeError, LookupError):
                continue
            assert r.encoding == encoding and r.nul == ("\0" in text) and r.lines == [x for x in text.splitlines() if x.strip()][:20]
            break
        else:
            assert r.encoding is None and r.lines == []
    return found


def test_streamed_files_keep_all_rules(spark, file, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "WINDOW", 64)
    rng = random.Random(1)
    bom = b"\xef\xbb\xbf"
    files = {"a b+%.csv": bom + b"a\r\nb\n\nc\rd", "e.csv": b"x,y\n1,2\n", "bom.csv": bom, "bomnl.csv": bom + b"\n", "nl.csv": b"\n\n", "nul.csv": b"a\x00b\n", "l.csv": b"n\x81\n",
             "w.csv": "\u201cé\u201d\n".encode("cp1252"), "u16.csv": "\ufeffnäme,\u0a0a\u0a0d\nx,\u0a41\n".encode("utf-16-le"), "u16b.csv": "a,b\nx,y\n".encode("utf-16"),
             "be.csv": "\ufeffa,b\nx,y\n".encode("utf-16-be"), "sj.csv": "名前,値\nア,ソ\n".encode("cp932"), "late.csv": b"a,b\n" * 30000 + b"\xe9\n",
             "cr.csv": b"a,b\r" + b"1,2\r" * 40, "blank.csv": b" \n\x0b\n" * 5000,
             "long.csv": b"".join(rng.choice([b"a,b\n", b"\r\n", b"  \n", b"x" * 5000 + b"\n", b"\xc3\xa9\n", b"q\r"]) for _ in range(20000))}
    for name, content in files.items():
        file(content, name)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = compare_facts(spark, tmp_path, files, IntakeConfig(encodings=("utf-8-sig", "shift_jis", "utf-16", "nope", "base64", "cp1252", "latin-1")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found["u16.csv"].encoding == "utf-16" and found["sj.csv"].encoding == "shift_jis"
    compare_facts(spark, tmp_path, files, IntakeConfig())
    none = compare_facts(spark, tmp_path, files, IntakeConfig(encodings=("nope",)))
    assert none["e.csv"].encoding is None
    codes = {r.file_name: r.code for r in X.file_manifest(X.read_files(spark, str(tmp_path), IntakeConfig(encodings=("nope",)))).collect()}
    assert codes["e.csv"] == "unsupported_encoding" and codes["nul.csv"] == "binary_content"


def test_compressed_names_have_no_facts(spark, file):
    r = X.file_manifest(X.read_files(spark, file(gzip.compress(b"a,b\n1,2\n"), "t.csv.gz"))).first()
    assert r.code == "invalid_extension" and r.fingerprint_sha256 is None


def random_table(seed, rows=60):
    rng = random.Random(seed)
    cells = ["a", "x y", "", "é", 'q "" z', "l1\nl2", "\r\n", "c\rd", ",", '"', "  ", "last\n", "😀" * 30, "n" * 200, '5" in', '\n"\n']
    return [[str(i), *(rng.choice(cells) for _ in range(3))] for i in range(rows)]


def as_csv(table, end, seed):
    """Quoted where it must be, and now and then where it need not."""
    rng = random.Random(seed)
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') and c != '5" in' or rng.random() < 0.2 else c
    lines = [",".join(map(quote, r)) for r in [["id", "p", "q", "r"], *table]]
    return "".join(line + end + (end if rng.random() < 0.1 else "") for line in lines)


@pytest.mark.parametrize("encoding, end", [("utf-8-sig", "\n"), ("utf-8-sig", "\r\n"), ("latin-1", "\n"), ("utf-16", "\r\n"), ("utf-16-be", "\n"), ("cp932", "\n")])
def test_quoted_line_ends_are_read_in_blocks(spark, tmp_path, monkeypatch, encoding, end):
    monkeypatch.setattr(records, "ROWS", 7)
    tables = {f"{name}.csv": random_table(seed, n) for seed, (name, n) in enumerate([("a", 400), ("b", 3), ("c", 60)])}
    if encoding in ("latin-1", "cp932"):
        tables = {f: [[c.replace("😀", "x").replace("é", "e" if encoding == "cp932" else "é") for c in r] for r in t] for f, t in tables.items()}
    for name, t in tables.items():
        (tmp_path / name).write_bytes(as_csv(t, end, 1).encode(encoding))
    fmt = X.CsvFormat(("id", "p", "q", "r"), ",", encoding)
    want = [[None if c in X.MISSING_TEXTS else c for c in r] for f in sorted(tables) for r in tables[f]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300b", "1k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            scan = X.scan_csv(spark, str(tmp_path), fmt=fmt, multi_line=True)
            assert [list(map(lambda c: None if c is None else str(c), r))[:4] for r in scan.table.orderBy("_ord").collect()] == want
            places = X.with_positions(stage_columns(scan.placed)).orderBy("_ord").collect()
            assert [r["_ord"] for r in places] == list(range(len(want))) and [str(r.id) for r in places] == [r[0] for r in want]
            if size == "300b" and encoding == "utf-8-sig":
                tasks = records.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions()
                assert tasks > 20  # the long file alone is cut into many blocks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_blocks_equal_one_task_on_random_quoted_files(spark, file, tmp_path):
    """Stray quotes, open quotes at the end and fields of many lines, against Spark's reader of whole files."""
    rng = random.Random(9)
    parts = ['a,b\n', '1,"x\ny"\n', '2,"""\n"\n', '3,5" in\n', '4,"p"q\n', '\n', '5,"' + "z\n" * 40 + '"\n', '"6\n",\n', "7,w\n"]
    path = file("h1,h2\n" + "".join(rng.choice(parts) for _ in range(300)) + '8,"open')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        found = records.read_records(spark, path, records.Formats.one(",", "utf-8")).orderBy("rank", "n").select(F.from_csv("record", "c0 string, c1 string", {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = spark.read.schema("c0 string, c1 string").option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in want] and len(found) > 200


def test_the_rule_of_record_ends_for_any_cut():
    rng = random.Random(3)
    cells = ["a", "", "x y", '"q,""\n"', '"\r\nz"', '"a\rb"', '""', '"""",', "5 in", '5" in', '"a"b']
    quoting = records.Quoting(",")
    for _ in range(3000):
        text = "".join(",".join(rng.choice(cells) for _ in range(rng.randrange(1, 4))) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randrange(1, 6)))
        lines = text.encode().split(b"\n")[:-1]
        want = [d for _, d in quoting.records(lines, False)]
        cuts = sorted(rng.choices(range(len(lines) + 1), k=2))
        got, inside = [], False
        for block in (lines[: cuts[0]], lines[cuts[0] : cuts[1]], lines[cuts[1] :]):
            for kind, data in quoting.records(block, inside) if block else ():
                if kind == records.GOES_ON:
                    got[-1] += b"\n" + data
                else:
                    got.append(data)
            inside = quoting.effect(block)[inside]
        assert got == want
        plain = lambda rows: [r for r in rows if r and (len(r) > 1 or r[0].strip())]
        assert plain(next(csv.reader(io.StringIO(d.decode(), newline=""))) for d in want) == plain(csv.reader(io.StringIO(text, newline="")))


def test_audit_from_a_path_keeps_positions_and_file_facts(spark, file, tmp_path):
    file("a,b\n1,x\n2,y\n", "p1.csv")
    file("a,b\n" + "".join(f"{i},z{i}\n" for i in range(3, 200)) + "1,x\n", "p2.csv")
    a = audit_csv(spark, str(tmp_path))
    assert a.check("duplicates").first()["example_duplicate_indices"] == ["199"]
    m = a.metadata.first()
    assert (m.file_name, m.row_count, m.column_count, m.code, m.encoding, m.delimiter) == (tmp_path.name, 200, 2, None, "utf-8-sig", ",")
    assert m.file_size_bytes == sum(f.stat().st_size for f in tmp_path.iterdir()) and len(m.fingerprint_sha256) == 64

    one = audit_csv(spark, str(tmp_path / "p1.csv"), dataset="p1")
    m = one.report("2026-01-01T00:00:00Z").first()["file_metadata"]
    assert (m.file_name, m.fingerprint_sha256) == ("p1.csv", hashlib.sha256(b"a,b\n1,x\n2,y\n").hexdigest())


def test_positions_do_not_depend_on_how_files_are_split(spark, file, tmp_path):
    file("n\n" + "".join(f"{i}\n" for i in range(500)), "p1.csv")
    file("n\n" + "".join(f"{i}\n" for i in range(500, 700)), "p2.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        scan = X.scan_csv(spark, str(tmp_path))
        assert scan.table.rdd.getNumPartitions() > 2
        rows = X.with_positions(stage_columns(scan.placed)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.n == r["_ord"] for r in rows) and len(rows) == 700


def test_preview_limits(spark):
    df = spark.range(200)
    assert [r.id for r in sinks.preview_rows(df, "id", 3).collect()] == [0, 1, 2]
    for bad in (0, 101, True, "5"):
        with pytest.raises(AuditError):
            sinks.preview_rows(df, "id", bad)


def test_heads_longer_than_the_first_read(spark, file, monkeypatch):
    monkeypatch.setattr(streams, "WINDOW", 64)
    wide = ";".join(f"column {i}" for i in range(40))
    row = ";".join("é" * 3 for _ in range(40))
    fmt = X.detect_format(spark, file(f"\n{wide}\n" + f"{row}\n" * 3))
    assert fmt.delimiter == ";" and len(fmt.names) == 40 and fmt.names[-1] == "column 39"
    many = X.detect_format(spark, file("a|b\n" + "1|2\n" * 100, "u.csv"))
    assert many.delimiter == "|" and many.names == ("a", "b")


def mixed_folder(tmp_path):
    (tmp_path / "sub").mkdir()
    tables = {"a": "id,b\n1,x\n2,y\n2,y\n", "sub/a": "id;b;c\n1;2.5;true\n2;;False\n", "t": "k\tv\n1\t\"p\nq\"\n2\tr\n", "one": "only\n5\n7\n",
              "blank": ",w,\n1,x,\n2,y,\n", "wide": ",".join(f"c{i}" for i in range(30)) + "\n" + ",".join("9" * 30) + "\n"}
    for name, text in tables.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "win.csv").write_bytes("n,m\n“é”x,1\n".encode("cp1252"))
    (tmp_path / "u16.csv").write_bytes("n,m\n\"é\n2\",1\nz,2\n".encode("utf-16"))
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,2,3\n")
    (tmp_path / "nul.csv").write_bytes(b"a,b\n1,\x002\n")
    (tmp_path / "twice.csv").write_bytes(b"a,A\n1,2\n")
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    (tmp_path / "none.csv").write_bytes(b"a,b\n,NA\n")
    (tmp_path / "note.txt").write_bytes(b"a,b\n1,2\n")
    return [*tables, "win", "u16"]


def test_a_folder_of_different_tables_equals_each_file(spark, tmp_path):
    good = mixed_folder(tmp_path)
    intake = IntakeConfig(encodings=("utf-8-sig", "utf-16", "cp1252"))
    scan = folder.scan_folder(spark, str(tmp_path), intake)
    files = {r.dataset: r for r in scan.files.collect()}
    wrong = {"bad": "parser_error", "nul": "binary_content", "twice": "duplicate_columns", "head": "no_data_rows", "none": "all_rows_empty", "note.txt": "invalid_extension"}
    assert {n: r.code for n, r in files.items() if r.code} == wrong and scan.names() == sorted(good)
    for name in good:
        alone = X.scan_csv(spark, str(tmp_path / f"{name}.csv"), intake)
        here = scan.table(name)
        assert here.dtypes[:-1] == alone.table.dtypes[:-1]
        rows = lambda df: [tuple(r)[:-1] for r in df.orderBy("_ord").collect()]
        assert rows(here) == rows(alone.table) and [r["_ord"] for r in here.orderBy("_ord").collect()] == list(range(alone.row_count))
        assert (files[name].row_count, files[name].column_count) == (alone.row_count, len(alone.format.names))
        assert files[name].warnings == [r.code for r in alone.warnings().collect()]
        assert files[name].fingerprint_sha256 == hashlib.sha256((tmp_path / f"{name}.csv").read_bytes()).hexdigest()
    with pytest.raises(AuditError):
        scan.table("bad")


def test_jobs_of_a_folder_do_not_grow_with_its_files(spark, tmp_path):
    def jobs(n):
        path = tmp_path / str(n)
        path.mkdir()
        for i in range(n):
            (path / f"f{i}.csv").write_text(f"h{i}{';,'[i % 2]}b\n{i}{';,'[i % 2]}x\n")
        spark.sparkContext.setJobGroup(f"folder-{n}", "folder")
        try:
            scan = folder.scan_folder(spark, str(path))
            assert scan.files.where("code IS NULL").count() == n and scan.columns.count() == 2 * n
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folder-{n}"))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
    assert jobs(40) <= jobs(4) + 3


def test_audit_of_every_file_equals_audits_of_each(spark, tmp_path):
    for name, text in {"a": "id,b\n1,x\n2,y\n2,y\n3,\n", "b": "k;v\n" + "".join(f"{i};{i * i}\n" for i in range(30)) + "5;99999\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    both = audit_csv(spark, str(tmp_path), per_file=True)
    for name in ("a", "b"):
        alone = audit_csv(spark, str(tmp_path / f"{name}.csv"), dataset=name)
        for result in ("score", "issues", "overview", "metadata"):
            one = lambda df: sorted(map(str, df.where(F.col("dataset") == name).collect()))
            assert one(getattr(both, result)) == one(getattr(alone, result))
