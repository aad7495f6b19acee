from __future__ import annotations

import math
import random
import re

import pyarrow as pa

from tests.llm import edge
from tidepool.llm.secrets import CHARACTERS, FORMATS, Grammar, Scorer, Settings, credentials, find_secrets, learn, others, redact, scan

ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text: str | None) -> list:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["é", "token", "=", "AKIA", "ABCDEFGH23", " ", ": ", "'", '"', "deadbeef0123456789", "api_key", "PASSWORD", "toKen", "\n", "1234567a", "😀", "ſecret", "toKen"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)] + [None, "", "deadbeef" * 9000]
    for t, spans in zip(texts, scan(pa.array(texts, pa.string()), learn())):
        assert [s for s in spans if s[1] < 3] == base(t), t
        added = [s for s in spans if s[1] == 3]
        assert not any(a[0] < b[2] and b[0] < a[2] for a in added for b in spans if b[1] < 3)


def test_fresh_credentials_are_found_and_other_strings_are_not():
    scorer = learn()
    more = Settings(examples=600)
    for name, texts in credentials(more).items():
        assert sum(map(scorer.accepts, texts[300:])) >= 0.95 * 300, name
    for name, texts in others(more).items():
        fresh = [t for t in texts[len(texts) // 2 :] if len(t) >= scorer.least]
        assert len(fresh) > 40 and not any(scorer.find(t) for t in fresh), name


def test_formats_keep_their_lengths_and_places():
    scorer, rng = learn(), random.Random(5)
    fill = lambda n: "".join(rng.choices(CHARACTERS[:62], k=n))
    for n in range(20, 60):
        found = sum(scorer.accepts("ghp_" + fill(n)) for _ in range(10))
        assert found >= 9 if n == 36 else found == 0, n
    assert not scorer.accepts(fill(20) + "ghp_" + fill(16))
    for name, parts in FORMATS.items():
        if name not in ("web-token", "chat-token"):
            lengths = sum(len(p) if isinstance(p, str) else p[1] for p in parts)
            assert len(scorer.formats[name][0]) == lengths + 1, name


def test_states_that_differ_stay_apart():
    grammar = Grammar(["0000"] * 60 + ["0A0A"] * 60)
    assert 1 < len(grammar.tables(0.02, 60)[0]) < 8
    assert len(Grammar(["0" * k for k in range(1, 60)] * 3).tables(0.02, 60)[0]) <= 3
    step, log = Grammar(["ab-c1", "ba-c2"] * 50).tables(1e-9, 1.0)
    assert len(step) == 6 and log[2][CHARACTERS.index("-")] > -1e-6 and log[3][CHARACTERS.index("c")] > -0.1 > log[4][CHARACTERS.index("1")]


def plain_gain(scorer: Scorer, text: str) -> float:
    def likelihood(step, log):
        at, total = 0, 0.0
        for c in text:
            at, total = step[at][CHARACTERS.index(c)], total + log[at][CHARACTERS.index(c)]
        return total + log[at][-1]

    best = max(likelihood(*t) for t in scorer.formats.values())
    return best - max([likelihood(*t) for t in scorer.plain.values()] + [len(text) * math.log(0.98 / 68) + math.log(0.02)])


def plain_added(scorer: Scorer, text: str) -> list:
    """Added spans, from the definition: every run without its base spans, cut at any choice of = and / or of = and / and dots, or not at all."""
    hidden = list(text)
    for b, _, e in base(text):
        hidden[b:e] = " " * (e - b)
    found = {}
    for run in re.finditer(r"[A-Za-z0-9+/_.=-]+", "".join(hidden)):
        for cuts in ("", "=/", "=/."):
            at = run.start()
            for part in re.split(f"([{cuts}])", run[0]) if cuts else [run[0]]:
                b, e = at, at + len(part)
                at = e
                if not cuts:
                    b, e = b + len(part) - len(part.lstrip("=/.")), b + len(part.rstrip("=/."))
                if e - b >= scorer.least and (gain := plain_gain(scorer, text[b:e])) >= scorer.settings.gain:
                    found[b, e] = gain
    out = []
    for b, e in sorted(found, key=lambda x: (-found[x], x)):
        if not any(b < y and x < e for x, y in out):
            out.append((b, e))
    return sorted(out)


def test_added_spans_equal_the_definition():
    rng, scorer = random.Random(3), learn()
    made = {**credentials(Settings(examples=20)), **others(Settings(examples=20))}
    pool = [t for x in made.values() for t in x]
    seps = [" ", "=", "/", ".", "é ", "://", "token=", "password: ", "&key=", "\n", "/x/", "-", "a"]
    texts = ["".join(rng.choice(seps) + rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    some = 0
    for t, spans in zip(texts, scan(pa.array(texts), scorer)):
        added = [(b, e) for b, k, e in spans if k == 3]
        assert added == plain_added(scorer, t), t
        some += len(added)
    assert some > 200


def test_credentials_within_paths_and_beside_base_spans():
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5"
    plain = "https://host.example/a/rather/long/path/of/words/"
    texts = [plain + key, f"url={plain}?key={key}&x=1", f"AKIA{'B' * 16}/{key}", key + "." + "x" * 40, f"{'deadbeef' * 4}.{key}"]
    for t, spans in zip(texts, scan(pa.array(texts), learn())):
        assert (t.index(key), 3, t.index(key) + len(key)) in spans, t
    long = "A" * 300_000 + "/" + key
    assert scan(pa.array([long]), learn())[0] == [(300_001, 3, 300_001 + len(key))]


def test_other_labelled_strings(spark):
    rng = random.Random(6)
    own = ["tide." + "".join(rng.choices("0123456789", k=14)) for _ in range(100)]
    scorer = Scorer.fit({"tide": own[:80]}, others())
    df = edge.documents(spark, [(1, f"see {own[90]} and ghp_{'aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5'}")])
    row = find_secrets(df, scorer=scorer).head()
    assert [(s["kind"], s["begin"], s["end"]) for s in row["spans"]] == [("grammar", 4, 23)]


def test_added_spans_and_redaction(spark):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5"
    rows = [(1, f"é call {key}, then password: hunter22x and hunter22y"), (2, None), (3, "clean text of ordinary words"), (4, "x" * 300)]
    df = edge.documents(spark, rows)
    got = {r["doc_id"]: [(s["kind"], s["begin"], s["end"]) for s in r["spans"]] for r in find_secrets(df).collect()}
    assert got[1] == [("grammar", 7, 7 + len(key)), ("assign", 7 + len(key) + 7, 7 + len(key) + 26)] and got[2] == got[3] == got[4] == []
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert clean[1] == "é call [SECRET], then [SECRET] and hunter22y" and clean[2] is None and clean[3] == rows[2][1]
    assert redact(df).columns == df.columns


def test_edge_rows(spark):
    df = edge.documents(spark)
    assert find_secrets(df).count() == redact(df).count() == len(edge.TEXTS)
    assert sorted(str(r["text"]) for r in redact(df).collect()) == sorted(str(t) for _, t in edge.TEXTS)
    assert find_secrets(edge.empty(spark)).count() == 0 and redact(edge.empty(spark)).count() == 0
