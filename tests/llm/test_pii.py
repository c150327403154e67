import hashlib
import random
import re


from cloneflow.llm import pii
from pyspark.sql import functions as F

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return sorted(found)


def texts():
    rng = random.Random(4)
    bits = ["a.b@c.de", "x@y", "@", "_", "%+", " ", "-", ".", "1", "255", "256", "007", "10.20.30.40", "1.2.3.4.5.6.7.8", "+1 (799) 555-3729", "+", "é", "\n"]
    bits += ["4363361756619572", "4363 3617 5661 9572", "4012-8888-8888-1881", "😀", "token = \"2b0cb261201f091f991b\"", "(", "w@example.com_x@d.e", "Mr. Éric Noir", "call 020 7946 0958"]
    made = [None, "", "a@b.c", "x" * 3000 + "@", "1" * 5000, "1." * 2000, "a@b." + "c." * 3000 + "d", "+1" + " 2" * 3000, "word " * 2000 + "a@b.cd"]
    made += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    made.append(" ".join(rng.choice(bits) for _ in range(4000)))
    return made


def test_base_spans(docs_of):
    made = texts()
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(made)).collect()}
    for i, text in enumerate(made):
        assert [(s.start, s.kind, s.stop) for s in got[i].base] == brute(text), repr(text[:200])
        assert set(got[i].base) <= set(got[i].spans)
        assert [tuple(s) for s in got[i].spans] == sorted(map(tuple, got[i].spans))


def test_report(docs_of):
    made = texts()[:400]
    for r in pii.report(docs_of(made)).collect():
        spans = brute(made[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert pii.report(docs_of([])).count() == 0


def test_plan_has_no_python(spark, docs_of):
    plan = pii.report(docs_of(["a@b.cd"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_expectation_maximisation_recovers_reliabilities():
    """Votes drawn from known rates: the posterior agrees with the truth far more often than the worst labeler."""
    rng = random.Random(1)
    rates = [(0.95, 0.05), (0.9, 0.2), (0.8, 0.1), (0.6, 0.5), (0.85, 0.15)]
    counts, truths = {}, {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = "".join("0" if rng.random() < 0.2 else "+" if rng.random() < (hit if true else false) else "-" for hit, false in rates)
        counts[votes] = counts.get(votes, 0) + 1
        truths.setdefault(votes, []).append(true)
    p = pii.reliabilities([(0, v, n) for v, n in counts.items()])
    right = sum(sum(t == (p[0, v] > 0.5) for t in ts) for v, ts in truths.items())
    assert right / 4000 > 0.93
    assert pii.reliabilities([]) == {}


def test_candidates_are_added_by_what_the_labelers_learn(docs_of):
    rng = random.Random(8)
    words = ["lorem", "ipsum", "dolor", "sit"]
    some = lambda: " ".join(rng.choice(words) for _ in range(6))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    made = [f"{some()} token = \"{key()}\" {some()}" for _ in range(60)] + [f"{some()} mail a{i}@b.org {some()}" for i in range(60)]
    made += [f"{some()} version 1234 567 8901 {some()}" for _ in range(60)]
    rows = pii.report(docs_of(made)).collect()
    assert sum("secret" in r.spans for r in rows) >= 55
    assert sum(r.n_email for r in rows) == 60
    assert not any("local_phone" in r.spans for r in rows)


EXAMPLES = {
    "email": ["a.b@c.de", "x_%+-@host-1.example.org"],
    "ip": ["10.20.30.40", "007.1.2.3"],
    "card": ["4363361756619572", "4012-8888-8888-1881", "1 2"],
    "phone": ["+1 (799) 555-3729", "+49.30.1234567"],
    "iban": ["ES9121000418450200051332", "GB82 WEST 1234 5698 7654"],
    "hidden_email": ["ann.lee(at)host.org", "ann [at] host [dot] org", "ann {at} host (dot) org"],
    "local_phone": ["020 7946 0958", "(030) 123 4567", "(030)123.4567", "030-1234-567"],
    "national_id": ["078-05-1120"],
    "secret": [
        f"{cue}{quote}{gap}{sign}{gap}{quote}hunter2hunter2x9"
        for cue in ("token", "secret", "passwd", "password", "apikey", "api_key")
        for quote in ("", '"', "'")
        for gap in ("", " ", "  ")
        for sign in "=:"
    ],
    "person": [f"{title}{dot} Éric{last}" for title in "Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Señor Señora".split() for dot in ("", ".") for last in ("", " Noir")],
}


def test_guard_holds_wherever_the_pattern_matches(spark):
    rows = [(k, t) for k, made in EXAMPLES.items() for t in made] + [("", t) for t in texts() if t]
    frame = spark.createDataFrame(rows, "kind string, text string")
    tests = [F.col("text").rlike(p).alias(f"{k.name}_{what}") for k in pii.KINDS for what, p in (("hit", k.pattern), ("guard", k.guard))]
    for r in frame.select("*", *tests).collect():
        assert not r.kind or r[f"{r.kind}_hit"], r
        for k in pii.KINDS:
            assert r[f"{k.name}_guard"] or not r[f"{k.name}_hit"], (k.name, r.text)


def candidates(docs_of, kind, made):
    """The matches of one kind in every text, accepted or not."""
    at = [k.name for k in pii.KINDS].index(kind)
    got = {r.doc_id: r.spans for r in pii.spans(docs_of(made)).collect()}
    return [[t[s.start : s.stop] for s in got[i] if s.kind == at] for i, t in enumerate(made)]


def test_secret_behind_a_password_cue_is_a_whole_candidate(docs_of):
    long = "aB3_" * 150
    made = ["password=hunter2hunter2x9", "passwd: abcdEFGH12345678", f"token={long} end", f"secret: '{long * 20}'", "passwords are long"]
    assert candidates(docs_of, "secret", made) == [["hunter2hunter2x9"], ["abcdEFGH12345678"], [long], [long * 20], []]


def test_ibans_of_every_length_are_whole_candidates(docs_of):
    """Listed and unlisted codes, unspaced and in groups of four, with a word in capitals behind the listed ones."""
    rng, made, want = random.Random(5), [], []
    codes = {n: c.split("|") for n, c in pii.IBAN_COUNTRIES.items()}
    for n in range(15, 35):
        for code in [*codes.get(n, []), "ZZ"]:
            iban = code + "".join(rng.choice("0123456789") for _ in range(n - 2))
            spaced = " ".join(iban[i : i + 4] for i in range(0, n, 4))
            behind = " EUR, BANK A" if code != "ZZ" else ", BANK A"
            for form in (iban, spaced):
                made.append(f"pay to {form}{behind} today")
                want.append([form])
    made += ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "x" + "DE89370400440532013000", "A" * 50 + "12" + "B" * 50, "AB12 CD"]
    want += [["DE89 3704 0044 0532 0130 00"], ["GB82WEST12345698765432"], [], [], []]
    assert candidates(docs_of, "iban", made) == want
    at = [k.name for k in pii.KINDS].index("iban")
    forms = {s.votes[0] for r in pii.spans(docs_of(made)).collect() for s in r.spans if s.kind == at}
    assert forms == {"+"}
