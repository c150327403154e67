import pytest

from cloneflow.operators.evaluate import score_failed
from cloneflow.operators.measures import MEASURES, features_of, long_scores, similarity_columns
from cloneflow.sources import corpus as cp

JAVA = """import java.util.List;
public class T {
    // adds two numbers
    int add(int x, int y) { return x + y; }
}
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    files = {
        "case-01/original/T1.java": JAVA,
        "case-01/plagiarized/L1/01/Cop y.java": JAVA,
        "case-01/plagiarized/L6/02/Main.java": JAVA.replace("add", "sum").replace("x", "a"),
        "case-01/non-plagiarized/01/Other.java": "class O { void run() { System.out.println(1); } }",
        "case-01/non-plagiarized/01/notes.txt": "no code",
        "case-02/original/A.java": JAVA,
        "case-02/original/B.java": JAVA,
        "case-02/plagiarized/L2/03/C.java": JAVA,
        "case-03/plagiarized/L2/03/D.java": JAVA,
        "case-04/original/E.java": "\t\n ",
        "case-04/plagiarized/L3/05/F.java": " ",
    }
    for name, code in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(code.replace("\n", "\r\n").encode())
    return str(base)


def test_scan_reads_whole_files_and_path_parts(spark, root):
    rows = {r.path.split("/corpus", 1)[1].split("/", 1)[1]: r for r in cp.read_corpus(spark, root).collect()}
    assert len(rows) == 10
    r = rows["case-01/plagiarized/L1/01/Cop y.java"]
    assert (r.case_id, r.role, r.level, r.author, r.stem, r.code) == ("case-01", "plagiarized", "L1", "01", "Cop y", JAVA)
    r = rows["case-01/non-plagiarized/01/Other.java"]
    assert (r.role, r.level, r.author) == ("non-plagiarized", None, "01")
    r = rows["case-01/original/T1.java"]
    assert (r.role, r.level, r.author) == ("original", None, None)


def test_unreadable_file_has_no_code(spark, tmp_path):
    folder = tmp_path / "case-09" / "original"
    folder.mkdir(parents=True)
    (folder / "X.java").write_bytes(b"\xff\xfe\xfa class")
    files = cp.read_corpus(spark, str(tmp_path))
    assert [(r.case_id, r.code) for r in files.collect()] == [("case-09", None)]
    suspect = tmp_path / "case-09" / "plagiarized" / "L1" / "01"
    suspect.mkdir(parents=True)
    (suspect / "Y.java").write_text("class Y { }")
    names = list(MEASURES)
    scored = similarity_columns(cp.make_pairs(cp.read_corpus(spark, str(tmp_path)), features_of(names)), names)
    assert [[r[n] for n in names] for r in scored.collect()] == [[None] * len(names)]
    scores = long_scores(scored, names)
    assert score_failed(scores, "drop").count() == 0
    assert {r.similarity for r in score_failed(scores, "zero").collect()} == {0.0}


def test_empty_files_have_an_empty_text(spark, tmp_path):
    files = {
        "case 1/original/A+b.java": JAVA,
        "case 1/plagiarized/L1/01/Cop y+é 100%.java": "",
        "case 1/plagiarized/L1/02/C.java": JAVA,
        "case 1/non-plagiarized/03/D%20.java": "",
        "case 1/non-plagiarized/03/notes.txt": "",
        "case 2/original/E.java": "",
        "case 2/plagiarized/L1/04/F.java": "",
    }
    for name, code in files.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(code)
    rows = cp.read_corpus(spark, str(tmp_path / "files")).collect()
    assert {r.path.split("/files/")[1]: r.code for r in rows} == {k: v for k, v in files.items() if k.endswith(".java")}
    assert len(rows) == 6 and {(r.case_id, r.role, r.level, r.author, r.stem) for r in rows if r.stem.startswith("Cop")} == {
        ("case 1", "plagiarized", "L1", "01", "Cop y+é 100%")
    }
    stored = cp.store_corpus(cp.read_corpus(spark, str(tmp_path / "files")), str(tmp_path / "stored"))
    scored = similarity_columns(cp.make_pairs(stored, features_of(["jaccard"])), ["jaccard"])
    got = sorted((r.path.rsplit("/", 1)[1], r.is_clone, r.jaccard) for r in scored.collect())
    assert got == [("C.java", True, 1.0), ("Cop y+é 100%.java", True, 0.0), ("D%20.java", False, 0.0), ("F.java", True, 0.0)]


def test_written_corpus_is_read_back(spark, tmp_path):
    rows = [("c1", "original", "7", "a\r\nb"), ("c1", "plagiarized", "8", ""), ("c 2", "non-plagiarized", "9", None)]
    cp.write_corpus(spark.createDataFrame(rows, "case_id string, role string, author string, code string"), str(tmp_path / "files"))
    read = cp.read_corpus(spark, str(tmp_path / "files"), ".txt").collect()
    assert sorted((r.case_id, r.role, r.author, r.level, r.code) for r in read) == [
        ("c 2", "non-plagiarized", "9", None, ""),
        ("c1", "original", "7", None, "a\nb"),
        ("c1", "plagiarized", "8", None, ""),
    ]


@pytest.mark.parametrize(("name", "moved"), [("metric_profile", False), ("call_similarity", False), ("jaccard", True)])
def test_compact_features_move_no_text(spark, capsys, name, moved):
    rows = [(f"c{i % 3}", i, "x", f"int f{i % 4}(int a) {{ return g(a, {i}); }}") for i in range(30)]
    table = spark.createDataFrame(rows, "case_id string, doc_id long, label string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = cp.star_pairs(table, features_of([name]), broadcast_bytes=0)
        pairs.explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = capsys.readouterr().out.split("\n\n")
    inputs = [p for p in parts if ") Exchange" in p and "hashpartitioning(case_id" in p]
    assert inputs and any("_body" in p or "_text" in p for p in inputs) == moved
    near = cp.star_pairs(table, features_of([name]))
    got, want = (sorted(map(repr, similarity_columns(p, [name]).select("case_id", "doc_id", name).collect())) for p in (pairs, near))
    assert got == want and len(got) == 27


def test_originals(spark, root):
    good, rejected = cp.pick_originals(cp.read_corpus(spark, root))
    assert sorted((r.case_id, r.stem) for r in good.collect()) == [("case-01", "T1"), ("case-04", "E")]
    assert sorted((r.case_id, r.originals) for r in rejected.collect()) == [("case-02", 2), ("case-03", 0)]


def test_pairs_and_scores(spark, root, tmp_path):
    stored = cp.store_corpus(cp.read_corpus(spark, root), str(tmp_path / "stored"))
    pairs = cp.make_pairs(stored, features_of(["jaccard", "comment_similarity", "call_similarity"]))
    scored = similarity_columns(pairs, ["jaccard", "comment_similarity", "call_similarity"])
    got = {r.path.rsplit("/", 1)[1]: r for r in scored.collect()}
    assert {k: r.is_clone for k, r in got.items()} == {"Cop y.java": True, "Main.java": True, "Other.java": False, "F.java": True}
    assert (got["Cop y.java"].jaccard, got["Cop y.java"].comment_similarity, got["Cop y.java"].call_similarity) == (1, 1, 1)
    assert 0 < got["Main.java"].jaccard < 1 and got["Main.java"].call_similarity == 0
    assert got["Other.java"].comment_similarity == 0
    assert (got["F.java"].jaccard, got["F.java"].comment_similarity) == (0, 1)


def test_no_listed_file_vanishes(spark, tmp_path):
    """A file that cannot be read has a row without code, and says so; its pair is there and scores zero."""
    rows = [("c1", "original", "1", JAVA), ("c1", "plagiarized", "2", JAVA), ("c1", "plagiarized", "3", None), ("c1", "non-plagiarized", "4", "class A {}")]
    root = str(tmp_path / "files")
    cp.write_corpus(spark.createDataFrame(rows, "case_id string, role string, author string, code string"), root)
    broken = tmp_path / "files" / "case_id=c1" / "role=plagiarized" / "author=2"
    (broken / ".text.txt.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\xde\xad\xbe\xef")
    (tmp_path / "files" / "case_id=c1" / "role=non-plagiarized" / "author=4" / "text.txt").write_bytes(b"\xff\xfe")
    files = cp.read_corpus(spark, root, ".txt")
    got = {r.author: (r.status, r.code) for r in files.collect()}
    assert got == {"1": ("read", JAVA), "2": ("unreadable", None), "3": ("empty", ""), "4": ("not text", None)}
    pairs = cp.make_pairs(files, features_of(["jaccard"]))
    scores = long_scores(similarity_columns(pairs, ["jaccard"]), ["jaccard"])
    assert scores.count() == 3 and score_failed(scores, "zero").count() == 3


def test_files_are_listed_and_read_in_the_tasks(spark, tmp_path, monkeypatch):
    """Not by Spark's file index, whose list is the driver's, and which gives up names with a colon."""
    monkeypatch.setattr(cp, "READ_BYTES", 4)
    folder = tmp_path / "files" / "c1" / "original"
    folder.mkdir(parents=True)
    names = {"a:b.txt": b"x\r\ny\rz\n", "A.txt": "é\U0001f600".encode(), "s.txt": b"\xed\xa0\x80", "e.txt": b""}
    for name, data in names.items():
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.code, r.status) for r in cp.read_corpus(spark, str(tmp_path / "files"), ".txt").collect()}
    assert got == {"a:b.txt": ("x\ny\nz\n", "read"), "A.txt": ("é\U0001f600", "read"), "s.txt": (None, "not text"), "e.txt": ("", "empty")}
