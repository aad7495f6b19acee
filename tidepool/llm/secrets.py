"""Operator 8: secret scans with inferred grammars.

For each kind of labelled credential, and for each kind of labelled string that is none (plain names, UUIDs, hashes, base64, numbers), a
prefix tree is folded into a probabilistic automaton: two states are merged when neither their ends, nor their ways on, nor the characters
they show, nor those of the states after them can be told apart at a confidence level. Signs that every example has equally often are symbols
of their own, all other characters are one symbol, so that a state stands for a place in the format, and formats keep their lengths.

Every unbroken run of credential characters, what fixed patterns leave of it, and its parts between = and / and . are scored by how much
likelier the best credential automaton makes them than the best other one, or than evenly drawn characters; those beyond a threshold are
added to what the fixed patterns find.

Cases: a null text is an empty one; an empty text has no spans; texts of any length are read whole; repeated rows get equal spans;
overlapping finds of different base kinds all stay, an added span never overlaps a base one; of overlapping candidates the one that gains
most is added; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, map_texts, ref, row_bytes

#: The base patterns and their least lengths (of group 2 for assign, else of the match).
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "grammar")

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
HEX, BASE62, BASE64 = DIGITS + "abcdef", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/"
URL64 = UPPER + LOWER + DIGITS + "-_"
#: The published shapes of common credentials, as (literal or (characters, least, most)) parts.
FORMATS: dict[str, list] = {
    "access-key": ["AKIA", (UPPER + "234567", 16, 16)],
    "git-token": ["ghp_", (BASE62, 36, 36)],
    "git-fine-token": ["github_pat_", (BASE62, 22, 22), "_", (BASE62, 59, 59)],
    "lab-token": ["glpat-", (BASE62, 20, 20)],
    "package-token": ["npm_", (BASE62, 36, 36)],
    "hub-token": ["hf_", (UPPER + LOWER, 34, 34)],
    "mail-key": ["SG.", (URL64, 22, 22), ".", (URL64, 43, 43)],
    "chat-token": ["xoxb-", (DIGITS, 10, 12), "-", (DIGITS, 10, 12), "-", (BASE62, 24, 24)],
    "pay-key": ["sk_live_", (BASE62, 24, 24)],
    "map-key": ["AIza", (URL64, 35, 35)],
    "web-token": ["eyJ", (URL64, 30, 60), ".eyJ", (URL64, 40, 90), ".", (URL64, 43, 43)],
}

SIGNS = "+/_.=-"
CHARACTERS = BASE62 + SIGNS
NUMBER = {c: i for i, c in enumerate(CHARACTERS)}
END = len(CHARACTERS)
#: Classes of characters, which a state's unseen characters borrow from.
CLASSES = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", DIGITS, *SIGNS]
_class_of = np.array([next(k for k, cs in enumerate(CLASSES) if c in cs) for c in CHARACTERS])
_class_size = np.array([len(cs) for cs in CLASSES])
#: The symbol of all characters that aren't symbols of their own.
ANY = "x"


@dataclass(frozen=True)
class Settings:
    """examples: labelled strings per kind. alpha: level of the test that keeps states apart. gain: least log likelihood ratio of a secret.
    unseen: probability of what a state has not shown, and the root of that of an end that it has not. borrow: how many characters a state's class shares count as."""

    examples: int = 300
    alpha: float = 0.05
    gain: float = 8.0
    unseen: float = 1e-5
    borrow: float = 60.0


def credentials(settings: Settings = Settings()) -> dict[str, list[str]]:
    """Seeded examples of each format."""
    rng = random.Random(8)
    fill = lambda p: p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2])))
    return {name: ["".join(map(fill, parts)) for _ in range(settings.examples)] for name, parts in FORMATS.items()}


def others(settings: Settings = Settings()) -> dict[str, list[str]]:
    """Seeded examples of long strings that are no credentials, by kind."""
    rng = random.Random(9)
    syllables = [c + v for c in "b c d f g h k l m n p r s t v w th st tr en er in un re".split() for v in "a e i o u ea ou an en ion er".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    words = lambda least, most: [word() for _ in range(rng.randint(least, most))]
    chars = lambda of, n: "".join(rng.choices(of, k=n))
    plain = [
        lambda: "".join(words(3, 6)), lambda: "_".join(words(2, 5)), lambda: "-".join(words(2, 6)) + rng.choice(["", f"-{rng.randrange(2030)}"]),
        lambda: "/".join(words(2, 6)) + rng.choice(["", ".html", ".py", "/"]), lambda: "".join(map(str.capitalize, words(2, 6))),
        lambda: ".".join(words(2, 5)), lambda: "".join(words(3, 6)).upper(), lambda: "_".join(words(2, 5)).upper(),
    ]
    uuid = lambda of: "-".join(chars(of, n) for n in (8, 4, 4, 4, 12))
    number = [lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", lambda: chars(DIGITS, rng.randint(8, 30)), lambda: rng.choice("=-_.") * rng.randint(20, 60)]
    made = {
        "plain": lambda k: plain[k % len(plain)](),
        "uuid": lambda k: uuid(HEX),
        "uuid-upper": lambda k: uuid(HEX.upper()),
        "hash": lambda k: chars(HEX, (32, 40, 64)[k % 3]),
        "hash-upper": lambda k: chars(HEX.upper(), (32, 40, 64)[k % 3]),
        "base64": lambda k: chars(BASE64, rng.choice([64, 76, rng.randint(16, 110)])) + "=" * rng.choice([0, 0, 1, 2]),
        "number": lambda k: number[k % len(number)](),
    }
    return {name: [make(k) for k in range(settings.examples * (3 if name == "plain" else 1))] for name, make in made.items()}


@dataclass
class State:
    """came, ended: examples. ways: symbol to state; took: symbol to examples. shown: how often each character stood for ANY here."""

    came: int = 0
    ended: int = 0
    ways: dict[str, int] = field(default_factory=dict)
    took: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    shown: dict[int, int] = field(default_factory=lambda: defaultdict(int))


class Grammar:
    """A probabilistic automaton folded from the prefix tree of examples."""

    def __init__(self, examples: list[str], alpha: float = 0.05) -> None:
        self.fixed = {c for c in SIGNS if len({x.count(c) for x in examples}) == 1 and c in examples[0]}
        self.states = [State()]
        for text in examples:
            at = 0
            self.states[0].came += 1
            for c in text:
                s, k = self.states[at], c if c in self.fixed else ANY
                s.took[k] += 1
                if k == ANY:
                    s.shown[NUMBER[c]] += 1
                if k not in s.ways:
                    s.ways[k] = len(self.states)
                    self.states.append(State())
                at = s.ways[k]
                self.states[at].came += 1
            self.states[at].ended += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold()

    def _differ(self, a: dict, n: int, b: dict, m: int) -> bool:
        least = self.slack * (n**-0.5 + m**-0.5)
        return least < 1 and any(abs(a.get(k, 0) / n - b.get(k, 0) / m) > least for k in a.keys() | b.keys())

    def _alike(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        for a, b in pairs:
            p, q = self.states[a], self.states[b]
            if self._differ({None: p.ended, **p.took}, p.came, {None: q.ended, **q.took}, q.came):
                return False
            pairs += [(p.ways[k], q.ways[k]) for k in p.ways if k in q.ways]
        for a, b in pairs:
            p, q = self.states[a], self.states[b]
            if p.shown and q.shown and self._differ(p.shown, p.took[ANY], q.shown, q.took[ANY]):
                return False
        return True

    def _fold(self) -> None:
        """Settled states stay apart; the most travelled state that follows one is merged into the first settled state that it is like,
        or is settled itself."""
        settled = [0]
        while True:
            seen = set(settled)
            edge = {q: (s, k) for s in settled for k, q in self.states[s].ways.items() if q not in seen}
            if not edge:
                return
            new = max(edge, key=lambda q: (self.states[q].came, -q))
            into = next((s for s in settled if self._alike(s, new)), None)
            if into is None:
                settled.append(new)
                continue
            s, k = edge[new]
            self.states[s].ways[k] = into
            todo = [(into, new)]
            while todo:
                a, b = todo.pop()
                p, q = self.states[a], self.states[b]
                p.came += q.came
                p.ended += q.ended
                for c, n in q.shown.items():
                    p.shown[c] += n
                for k, n in q.took.items():
                    p.took[k] += n
                    if k not in p.ways:
                        p.ways[k] = q.ways[k]
                    elif p.ways[k] != q.ways[k]:
                        todo.append((p.ways[k], q.ways[k]))

    def tables(self, unseen: float, borrow: float) -> tuple[list[list[int]], list[list[float]]]:
        """(next state by state and character, log probability of each character and of the end)."""
        number, order = {0: 0}, [0]
        for s in order:
            for q in self.states[s].ways.values():
                if q not in number:
                    number[q] = len(order)
                    order.append(q)
        step, log = np.zeros((len(order), END), np.int64), np.zeros((len(order), END + 1))
        free = np.array([c not in self.fixed for c in CHARACTERS])
        for i, s in enumerate(order):
            state, share = self.states[s], np.zeros(END + 1)
            for k, n in state.took.items():
                if k == ANY:
                    shown = np.zeros(END)
                    shown[list(state.shown)] = list(state.shown.values())
                    shares = np.bincount(_class_of, shown, len(CLASSES)) / shown.sum()
                    share[:END] += n / state.came * (shown + borrow * (shares / _class_size)[_class_of]) / (shown.sum() + borrow)
                    step[i, free] = number[state.ways[k]]
                else:
                    share[NUMBER[k]] += n / state.came
                    step[i, NUMBER[k]] = number[state.ways[k]]
            share[END] = state.ended / max(state.came, 1)
            log[i] = np.log((1 - unseen) * share + unseen / (END + 1))
            if not state.ended:
                log[i, END] = 2 * np.log(unseen)
        return step.tolist(), log.tolist()


@dataclass
class Scorer:
    """Tables of the automata of credentials and of other strings; least: characters of the shortest labelled credential."""

    formats: dict[str, tuple]
    plain: dict[str, tuple]
    least: int
    settings: Settings

    @staticmethod
    def fit(credentials: dict[str, list[str]], others: dict[str, list[str]], settings: Settings = Settings()) -> Scorer:
        """From labelled strings of A-Z a-z 0-9 + / _ . = -, by kind."""
        made = lambda kinds: {n: Grammar(x, settings.alpha).tables(settings.unseen, settings.borrow) for n, x in kinds.items() if x}
        return Scorer(made(credentials), made(others), min((len(t) for x in credentials.values() for t in x), default=1), settings)

    @staticmethod
    def _log_likelihood(tables: tuple, numbers: list[int]) -> float:
        step, log = tables
        at, total = 0, 0.0
        for k in numbers:
            total += log[at][k]
            at = step[at][k]
        return total + log[at][END]

    def gain(self, text: str) -> tuple[str | None, float]:
        """(likeliest format, its log likelihood less that of the likeliest other kind of string)."""
        numbers = [NUMBER[c] for c in text]
        name, best = max(((n, self._log_likelihood(t, numbers)) for n, t in self.formats.items()), key=lambda x: x[1], default=(None, -math.inf))
        even = -len(text) * math.log(END / 0.98) + math.log(0.02)
        return name, best - max([even, *(self._log_likelihood(t, numbers) for t in self.plain.values())])

    def accepts(self, text: str) -> bool:
        return len(text) >= self.least and self.gain(text)[1] >= self.settings.gain

    def find(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of the secrets in an unbroken run: of the run and its parts, the ones that gain most."""
        parts = {(m.start(), m.end()) for p in _PARTS for m in p.finditer(text) if m.end() - m.start() >= self.least}
        scored = sorted((-g, b, e) for b, e in parts if (g := self.gain(text[b:e])[1]) >= self.settings.gain)
        out: list[tuple[int, int]] = []
        for _, b, e in scored:
            if not any(b < y and x < e for x, y in out):
                out.append((b, e))
        return sorted(out)


#: A run without the signs around it, and its parts between = and /, and between these and dots.
_PARTS = [re.compile(r"(?<![^.=/])[^.=/](?:.*[^.=/])?"), re.compile(r"[^=/]+"), re.compile(r"[^=/.]+")]


@lru_cache(maxsize=4)
def learn(settings: Settings = Settings()) -> Scorer:
    return Scorer.fit(credentials(settings), others(settings), settings)


_run = np.zeros(256, bool)
_run[list((BASE62 + "+/_.=-").encode())] = True
_hex = np.zeros(256, bool)
_hex[list(HEX.encode())] = True


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of unbroken runs of at least so many."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def scan(texts: pa.Array, scorer: Scorer) -> list[list[tuple[int, int, int]]]:
    """Of each text its spans, as (begin, number of kind, end) in code points, in order."""
    whole = as_bytes(texts)
    # one byte that belongs to no run stands between texts
    data = np.frombuffer(b"\n".join(whole) + b"\n", np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(b) + 1 for b in whole], dtype=np.int64)])
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(begins: np.ndarray, ends: np.ndarray, kind: int) -> None:
        for b, e in zip(begins.tolist(), ends.tolist()):
            i = int(np.searchsorted(edges, b, side="right")) - 1
            found[i].append((b - int(edges[i]), kind, e - int(edges[i])))

    add(*_runs(_hex[data], LEAST["hex"]), 2)
    for i, text in enumerate(whole):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if b"AKIA" in text:
            found[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    begins, ends = _runs(_run[data], scorer.least)
    for b, e in zip(begins.tolist(), ends.tolist()):
        i = int(np.searchsorted(edges, b, side="right")) - 1
        at, to = b - int(edges[i]), e - int(edges[i])
        free = []  # what the base spans leave of the run
        for x, _, y in sorted(s for s in found.get(i, ()) if s[1] < 3 and s[0] < to and at < s[2]):
            free.append((at, x))
            at = max(at, y)
        for x, y in [*free, (at, to)]:
            if y - x >= scorer.least:
                found[i] += [(x + p, 3, x + q) for p, q in scorer.find(whole[i][x:y].decode())]
    out: list[list[tuple[int, int, int]]] = [[] for _ in whole]
    for i, spans in found.items():
        if not whole[i].isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(whole[i], np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[b]), k, int(points[e])) for b, k, e in spans]
        out[i] = sorted(spans)
    return out


def _struct_list(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [s for x in found for s in x]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array([KINDS[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], names=["kind", "begin", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])


def find_secrets(df: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", scorer: Scorer | None = None, result: str = "spans") -> DataFrame:
    """`keep` columns of each row, and its spans array<struct<kind, begin, end>> by begin, then kind (assign, access, hex, grammar). scorer: of other labelled
    strings (Scorer.fit) than the seeded ones."""
    scorer = scorer or learn()

    def make():
        return lambda texts, _rows: [_struct_list(scan(texts, scorer))]

    return map_texts(df, text_col, keep or ["doc_id"], [T.StructField(result, T.ArrayType(SPAN))], make)


def redact(df: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", scorer: Scorer | None = None) -> DataFrame:
    """df's rows and columns, each joined stretch of spans in a text replaced by mark; null texts stay null."""
    scorer = scorer or learn()
    rest = [c for c in df.columns if c != text_col]
    name = "_" * (1 + max((len(c) for c in df.columns), default=0)) + "redacted"

    def make():
        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            found = scan(texts, scorer)
            if not any(found):
                return [texts]
            out = texts.to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    text, parts, at = out[i], [], 0
                    for b, _, e in spans:
                        if b >= at:
                            parts += [text[at:b], mark]
                        at = max(at, e)
                    out[i] = "".join([*parts, text[at:]])
            return [pa.array(out, texts.type)]

        return work

    done = map_texts(df, text_col, rest, [T.StructField(name, T.StringType())], make)
    return done.select(*[F.col(name).alias(c) if c == text_col else ref(c) for c in df.columns])
