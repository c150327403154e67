import random

from pyspark.sql import functions as F

from cloneflow.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    """`kept` of each (doc_id, text); a null id counts as no document."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20 and doc is not None:
                holders.setdefault(key_of(line), set()).add(doc)
    kept = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key_of(x), ())) < 3 or doc == max(holders[key_of(x)])]
        kept.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return kept


def made_up():
    rng = random.Random(3)
    lines = ["", " ", "short", "exactly twenty chars", "nineteen characters", "  Exactly TWENTY chars\t", "Ünder the bridge of SIGHS ", "ünder the bridge of sighs",
             "ÜNDER the bridge of sighs", " exactly twenty chars", "a line in every document\r", "😀" * 19, "😀" * 20]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "a line in every document\nmine"), (5, "a line in every document\nother text"), rows[7], (3, None)]
    rows += [(200 + i, "this line is in just two documents") for i in range(2)] + [(300, "\n".join(["a line in every document"] * 5000))]
    return rows


def test_against_brute_force(docs_of):
    rows = made_up()
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    made, name = linededup.dedup_lines(docs)
    assert made.columns == [*docs.columns, name]
    got = [(r.doc_id, r[name].n_lines, r[name].n_dropped, r[name].kept) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_no_documents(docs_of):
    made, _ = linededup.dedup_lines(docs_of([]))
    assert made.count() == 0


def test_plan_is_native_and_splits_once(docs_of):
    made, name = linededup.dedup_lines(docs_of([t for _, t in made_up()], [i for i, _ in made_up()]))
    plan = made.select("doc_id", F.sha2(f"{name}.kept", 256))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(") == 1
