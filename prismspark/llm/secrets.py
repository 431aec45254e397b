"""Secret scans with a random forest that removes false positives.

Candidates are long runs of key characters, values assigned to credential names, passwords in URLs, and private keys. Each is
described by its length, character transitions, dictionary coverage, the path it was found under and neighbouring
words; a forest trained on labelled findings scores it, and findings under the threshold are dropped. Candidates inside
others are scored too: what the forest rejects hides none of them. The dictionary is the most frequent words of the
documents, counted in Spark.

The forest is trained from a table of labelled findings, of which a bounded sample is read (`SAMPLE_ROWS` rows by a hash).
By default the table is made by labelled_findings(), from rules and a seed, since no table here has any; it is a fixed
sample of formats and of values that look like them. How a candidate was found (its kind) is told, but is no feature:
the forest alone decides. Edge cases: null and empty texts have no findings; a text of any length is
scanned whole; equal texts have equal findings; null paths are empty; an empty table gives an empty table; other
columns are kept by redact() and not read by scan().
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, small_or_not, texts_of

RUN = re.compile(r"[A-Za-z0-9_+/=~.:\-]{8,}")
#: The first line of a private key, what parts its lines (also when escaped or quoted), a line of it, and its last line. A
#: line is base64 alone: 16 characters or more, 40 behind a mere space, and fewer only before padding or the last line.
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_BREAK = r"(?:[ \t\"'+,;\\]{0,8}(?:\r?\n|\\r\\n|\\n)[ \t>|*#\"'+]{0,8}){1,3}"
KEY_LINE = re.compile(rf"{_BREAK}(?:(?:Proc-Type|DEK-Info|Version|Comment): ?[^\n\\]{{0,200}}|[A-Za-z0-9+/]{{16,}}={{0,2}}|[A-Za-z0-9+/]{{1,76}}={{1,2}}|[A-Za-z0-9+/]{{1,76}}(?=\s{{0,8}}-----END))(?=[ \t\r\n\"'+,;\\]|-----|\Z)|[ \t]{{0,8}}[A-Za-z0-9+/]{{40,}}={{0,2}}(?=\s|-----|\Z)")
KEY_END = re.compile(rf"(?:{_BREAK}|[ \t]{{0,8}})-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----")
NAME = re.compile(r"(?i)(?:^|[_.\-])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|auth|credentials?|bearer)$")
#: A credential name and its value up to the closing quote or, without one, to white space.
ASSIGNED = re.compile(r"""(?i)(?<![A-Za-z0-9])((?:[A-Za-z0-9]{1,40}[_.\-]){0,6}(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|auth|credentials?|bearer))["'`]?[ \t]{0,8}[=:][ \t]{0,8}(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|(?!//)([^\s"'`]+))""")
#: The password of scheme://user:password@host.
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{0,30}://[^\s/:@\"'<>]{0,200}:([^\s/\"'<>]+)@")
#: Formats of issued credentials.
ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+|glpat-[\w-]{20}")
GOOD_WORDS = frozenset("password passwd pwd secret token key apikey api_key auth bearer credential credentials private access login".split())
BAD_WORDS = frozenset("example sample dummy placeholder changeme your test commit sha sha1 sha256 md5 hash checksum digest uuid guid id version isbn phone tel order invoice card serial".split())
#: The dictionary: words that one document in 500 holds, 2,000 at most; what stands for them where there are no documents.
DICTIONARY_SHARE, DICTIONARY_WORDS = 1 / 500, 2000
#: Rows of a task whose words are counted together, and words up to which those to be counted are broadcast (20 bytes each).
PART_ROWS, BROADCAST_WORDS = 2000, 200_000
NO_DOCUMENTS = GOOD_WORDS | BAD_WORDS
WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,20}(?![^\W\d_])")
THRESHOLD = 0.5
#: Labelled findings that training reads at most.
SAMPLE_ROWS = 6000


def common_words(df: DataFrame, *, text: str = "text", share: float = DICTIONARY_SHARE, most: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The words of 3 to 20 letters that at least `share` of all documents hold, counted over all whole texts; of more than
    `most` the most frequent, ties going to the smaller word.

    A word of that share has it in one part of a task's rows at least: only words that have are counted over all, so that
    the many rare words are neither shuffled nor kept. The texts are read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: tuple[Counter, int]) -> pa.RecordBatch:
            n, docs = part
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs] * len(n), pa.int64())], ["word", "n", "docs"])

        held, part = None, (Counter(), 0)
        for batch in batches:
            for t in texts_of(batch.column(0)):
                part[0].update(set(WORD.findall(t.lower())))
            part = (part[0], part[1] + batch.num_rows)
            if part[1] >= PART_ROWS:
                if held:
                    yield row(held)
                held, part = part, (Counter(), 0)
        # The last rows go with the part before them: of a few rows every word would be frequent.
        if held:
            held[0].update(part[0])
            part = (held[0], held[1] + part[1])
        if part[0]:
            yield row(part)

    words = df.select(text).mapInArrow(run, "word string, n long, docs long")
    frequent = cut(words.filter(F.col("n") >= share * F.col("docs")).select("word").distinct(), "frequent")
    counted = words.join(small_or_not(frequent, BROADCAST_WORDS), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    whole = counted.filter(F.col("n") >= share * df.count())
    return frozenset(r[0] for r in whole.orderBy(F.desc("n"), "word").limit(most).collect())


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys: a first line, the lines of base64 that follow, and the last line if it comes next. Without any such
    line it is a mention of a key; what is not base64 ends a key, so that nothing behind it is swallowed."""
    out, at = [], 0
    while begin := KEY_BEGIN.search(text, at):
        at = end = begin.end()
        while line := KEY_LINE.match(text, end):
            end = line.end()
        if end > at:
            last = KEY_END.match(text, end)
            at = last.end() if last else end
            out.append((begin.start(), at))
    return out


def assigned(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    """Values of credential names, and those inside quoted values. A value has no unescaped quote of its own kind, so a
    character is inside three of them at most."""
    for m in ASSIGNED.finditer(text, start, end):
        quoted = 2 if m[2] is not None else 3 if m[3] is not None else 4 if m[4] is not None else 0
        first, last = m.span(quoted or 5)
        if not quoted:
            last -= len(m[5]) - len(m[5].rstrip(".,;:)]}>"))
        if last > first and not text.startswith("-----BEGIN", first):
            yield first, last, "issued" if ISSUED.fullmatch(text, first, last) else "assigned", m[1][-40:]
        if quoted:
            yield from assigned(text, first, last)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, name of each candidate value, by start and falling end, each span once; the name is what it is
    assigned to. Candidates may lie inside others: chosen() decides between them once they are scored. Values of credential
    names and passwords of URLs are taken whole, at any length and of any characters."""
    out = [(start, end, "private_key", "") for start, end in key_blocks(text)]
    out += assigned(text, 0, len(text))
    for m in URL.finditer(text):
        out.append((*m.span(1), "url_password", ""))
    for m in RUN.finditer(text):
        run, start = m.group(), m.start()
        name, offset = "", 0
        if (eq := max(run.rfind("=", 0, len(run.rstrip("="))), run.rfind(":", 0, len(run.rstrip(":"))))) >= 0:
            name, offset = run[:eq], eq + 1
        value = run[offset:].rstrip(".:=-") if not run.endswith("==") else run[offset:]
        if not offset:
            before = text[max(0, start - 40) : start].rstrip(" \t\"'`")
            if before[-1:] in ("=", ":"):
                name = before[:-1].rstrip(" \t\"'`").rsplit(None, 1)[-1] if before[:-1].strip(" \t\"'`") else ""
        start += offset
        named = bool(NAME.search(name))
        if len(value) < (1 if named else 16):
            continue
        kind = "issued" if ISSUED.fullmatch(value) else "assigned" if named else "run"
        out.append((start, start + len(value), kind, name[-40:]))
    spans: dict[tuple[int, int], tuple[int, int, str, str]] = {}
    for found in out:
        spans.setdefault(found[:2], found)
    return sorted(spans.values(), key=lambda c: (c[0], -c[1]))


def chosen(found: list[tuple[int, int, str, float]], threshold: float) -> list[tuple[int, int, str, float]]:
    """Of candidates that overlap, secrets come before what the forest rejects; then the first counts, and of those with one
    start the longest. found is in that order."""
    taken: list[tuple[int, int, str, float]] = []
    for secret in (True, False):
        kept, starts, reached = [], [f[0] for f in taken], 0
        for f in found:
            if (f[3] >= threshold) is secret and f[0] >= reached:
                after = bisect.bisect_left(starts, f[1])
                if after == 0 or taken[after - 1][1] <= f[0]:
                    kept.append(f)
                    reached = f[1]
        taken = sorted([*taken, *kept])
    return taken


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, start: int, end: int, name: str, path: str, dictionary: frozenset[str] = NO_DOCUMENTS) -> list[float]:
    """Length, transitions, coverage, path and neighbours of one candidate."""
    value = text[start:end]
    n = len(value)
    classes = [_class(c) for c in value]
    shares = [classes.count(k) / n for k in range(4)]
    moves = [0.0] * 4
    for (a, b), times in Counter(zip(classes, classes[1:], strict=False)).items():
        moves[0 if a == b else 1 if {a, b} == {0, 1} else 2 if {a, b} == {1, 2} else 3] += times / n
    counts = list(Counter(value).values())
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    words = re.findall(r"[A-Za-z][a-z]+|[A-Z]{3,}", value)
    covered = sum(len(w) for w in words if w.lower() in dictionary or w.lower() in BAD_WORDS) / n
    vowels = sum(c in "aeiouAEIOU" for c in value) / n
    before = text[max(0, start - 60) : start]
    near = re.findall(r"[a-z_0-9]+", before.lower())[-4:] + re.findall(r"[a-z]+", text[end : end + 40].lower())[:2]
    near = {w for token in near for w in (token, *token.split("_"))}
    parts = set(re.split(r"[^a-z0-9]+", path.lower()))
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:], strict=False)) / n
    called = NAME.search(name) is not None or bool(re.search(r"[=:][ \t\"'`]*$", before) and near & GOOD_WORDS)
    return [
        n, math.log(n), *shares, *moves, entropy, entropy / math.log2(max(n, 2)), covered, vowels, max(counts) / n, steps,
        float(bool(re.search(r"://[^\s/]*:$", before))), float(called), float(bool(near & GOOD_WORDS)), float(bool(near & BAD_WORDS)),
        float(value.count("-") == 4 and len(value) == 36), float(bool(parts & {"test", "tests", "example", "examples", "docs", "fixtures"})),
        float(len(set(value[:4]) & set("-_")) > 0), float(value[:4].isalpha() and value[:4].isupper() and n >= 16), float(sum(c in "0123456789abcdef" for c in value) / n), float(value.count(" ") + value.count("\n")) / n,
    ]


def labelled_findings(n: int = SAMPLE_ROWS, seed: int = 10, dictionary: frozenset[str] = NO_DOCUMENTS) -> list[tuple[str, int, int, str, str, str, int]]:
    """text, start, end, kind, name, path, label: findings of known truth, made from rules, the dictionary and a seed."""
    rng, common = random.Random(seed), sorted(dictionary | NO_DOCUMENTS)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    words = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))
    names = ["password", "token", "secret", "api_key", "apikey", "auth_token", "access_key", "db_password", "client_secret", "passwd", "pwd"]
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    true = [
        lambda: ("", pick(hexa, rng.choice([32, 40, 64]))), lambda: ("", pick(hexa, rng.randint(16, 24))), lambda: ("", pick(alnum, rng.randint(10, 48))), lambda: ("", pick(alnum + "+/", 40)),
        lambda: ("-", "AKIA" + pick(string.ascii_uppercase + "234567", 16)), lambda: ("-", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)), lambda: ("-", "ghp_" + pick(alnum, 36)), lambda: ("-", "sk_live_" + pick(alnum, 24)), lambda: ("-", "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)), lambda: ("-", "AIza" + pick(alnum, 35)),
        lambda: ("-", "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum, 43)), lambda: ("-", "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(rng.randbytes(300)).decode() + "\n-----END RSA PRIVATE KEY-----"),
    ]
    signs = alnum + "!@#$%^&*?"
    true += [
        lambda: ("", pick(string.ascii_lowercase, rng.randint(3, 6)) + pick(string.digits, rng.randint(0, 3)) + pick("!@#$%&*?", rng.randint(1, 2))), lambda: ("", pick(signs, rng.randint(6, 20))), lambda: ("", pick(string.ascii_letters, rng.randint(8, 40))),
        lambda: ("-", f"{rng.choice(['postgres', 'mysql', 'redis', 'amqp', 'https'])}://{words(1)}:{pick(rng.choice([alnum, signs.replace('@', ''), string.ascii_letters]), rng.randint(6, 24))}@{words(1)}/{words(1)}"),
        lambda: ("-", pick(string.ascii_letters, rng.randint(20, 48))), lambda: ("-", pick(rng.choice([string.ascii_lowercase, string.ascii_uppercase]), rng.randint(20, 48))),
    ]
    false = [
        lambda: ("", words(1)), lambda: ("", "_".join(words(2).split())), lambda: ("", rng.choice(["true", "false", "null", "none", "None", "changeme", "password", "secret", "your_token", "example", "str", "string", "xxxx", "****", "<token>", "${TOKEN}", "os.environ", "{}", "..."])), lambda: ("", f"{words(1)}.{words(1)}({words(1)})"),
        lambda: ("-", f"{rng.choice(['postgres', 'mysql', 'https'])}://{rng.choice(['user', words(1)])}:{rng.choice(['password', 'pass', 'changeme', 'xxxx', '<password>', '${PASSWORD}', 'example'])}@{words(1)}/{words(1)}"), lambda: ("-", "".join(w.title() for w in words(6).split())),
        lambda: ("-", rng.choice("/.-_:").join(words(rng.randint(3, 7)).split())), lambda: ("-", rng.choice(["", "/", "~/"]) + "/".join(rng.sample(common, 4)) + ".py"), lambda: ("-", rng.choice(["", "_"]).join(rng.sample(common, 4))), lambda: ("-", "".join(words(7).split())), lambda: ("-", rng.choice("/~_+ax") * rng.randint(16, 60)),
        lambda: ("", rng.choice(["changeme123", "your_password_here1", "example_token_value1", "xxxxxxxxxxxxxxxx1", "password1234", "12345678", "00000000000000000000", "test_test_test_01"])),
        lambda: ("-", pick(string.digits, rng.choice([16, 16, 18, 20]))), lambda: ("commit ", pick(hexa, 40)), lambda: ("sha256 checksum ", pick(hexa, 64)), lambda: ("md5 hash ", pick(hexa, 32)), lambda: ("id ", str(uuid.UUID(int=rng.getrandbits(128)))),
        lambda: ("-", "_".join(words(rng.randint(3, 5)).split()) + str(rng.randint(1, 99))), lambda: ("-", "https://" + words(1) + ".example.com/" + words(1) + "/" + pick(string.digits, 4)), lambda: ("-", words(1) + "." + str(rng.randint(1, 99)) + "@" + words(1) + rng.choice(["2", "7"]) + ".example.com"), lambda: ("-", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}"), lambda: ("-", "".join(words(5).split()) + str(rng.randint(1, 9))),
    ]
    out = []
    while len(out) < n:
        label = rng.random() < 0.5
        prefix, value = rng.choice(true if label else false)()
        before = f"{rng.choice(names)}{rng.choice(['=', ' = ', ': ', '=', ' = '])}{rng.choice(['', chr(34)])}" if prefix == "" else "" if prefix == "-" and rng.random() < 0.8 else prefix.strip("-")
        text = f"{words(6)} {before}{value} {words(5)}"
        path = rng.choice(["src/app.py", "config/prod.env", "src0", "src7", "web", ""]) if label or rng.random() < 0.7 else rng.choice(["tests/data.py", "docs/example.md", "examples/a.txt"])
        # Of a text with a secret only the value is one; of a URL, its password.
        begin, end, url = text.index(value), text.index(value) + len(value), "://" in value
        out += [(text, s, e, k, m, path, int(label and s < end and e > begin and (k == "url_password" or not url))) for s, e, k, m in candidates(text)]
    return out[:n]


class Forest:
    """Random forest of binary splits over binned features, stored as flat arrays, and the dictionary of its features."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], dictionary: frozenset[str] = NO_DOCUMENTS):
        self.trees, self.dictionary = trees, dictionary

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 10) -> Forest:
        rng = np.random.default_rng(seed)
        grown, some = [], max(1, int(math.sqrt(x.shape[1])) + 1)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            feature, cutoff, low, high, value = [], [], [], [], []

            def grow(rows: np.ndarray, level: int, lists=(feature, cutoff, low, high, value)) -> int:
                me, p = len(lists[0]), float(y[rows].mean())
                for column, v in zip(lists, (-1, 0.0, -1, -1, p), strict=True):
                    column.append(v)
                if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
                    return me
                best = (1e-9, -1, 0.0)
                for j in rng.permutation(x.shape[1])[:some]:
                    bins = np.searchsorted(edges[j], x[rows, j], side="left")
                    n = np.bincount(bins, minlength=len(edges[j]) + 1).cumsum()[:-1]
                    k = np.bincount(bins, y[rows], minlength=len(edges[j]) + 1).cumsum()[:-1]
                    total, good = len(rows), p * len(rows)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = k * k / n + (good - k) ** 2 / (total - n) - good * good / total
                    gain[(n < least) | (total - n < least)] = -1
                    if len(gain) and gain[b := int(gain.argmax())] > best[0]:
                        best = (float(gain[b]), int(j), float(edges[j][b]))
                if best[1] >= 0:
                    left = x[rows, best[1]] <= best[2]
                    lists[0][me], lists[1][me] = best[1], best[2]
                    lists[2][me], lists[3][me] = grow(rows[left], level + 1), grow(rows[~left], level + 1)
                return me

            grow(rows, 0)
            grown.append(tuple(np.array(c) for c in (feature, cutoff, low, high, value)))
        return cls(grown)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cutoff, low, high, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = rows[inner]
                k = at[i]
                at[i] = np.where(x[i, feature[k]] <= cutoff[k], low[k], high[k])
            total += value[at]
        return total / max(1, len(self.trees))


def fit(findings: list[tuple], dictionary: frozenset[str] = NO_DOCUMENTS) -> Forest:
    x = np.array([features(t, s, e, m, p, dictionary) for t, s, e, _, m, p, _ in findings], float)
    forest = Forest.fit(x, np.array([f[-1] for f in findings], float))
    forest.dictionary = dictionary
    return forest


def train(findings: DataFrame, *, sample_rows: int = SAMPLE_ROWS, dictionary: frozenset[str] = NO_DOCUMENTS) -> Forest:
    """Forest from a table of findings: text, start, end (code points), kind, name, path, label (1: a secret). The sample is
    bounded, so it may come to the driver; rows with nulls are left out."""
    columns = ["text", "start", "end", "kind", "name", "path", "label"]
    rows = findings.select(*columns).dropna().orderBy(F.xxhash64(*columns), *columns).limit(sample_rows).collect()
    return fit([tuple(r) for r in rows], dictionary)


@functools.cache
def forest_of(dictionary: frozenset[str] = NO_DOCUMENTS) -> Forest:
    """The forest of the findings made from rules, with this dictionary."""
    return fit(labelled_findings(SAMPLE_ROWS, dictionary=dictionary), dictionary)


def default_forest(docs: DataFrame | None = None, *, text: str = "text") -> Forest:
    """The forest whose dictionary is counted from docs; without docs, the words that its rules name."""
    return forest_of() if docs is None else forest_of(common_words(docs, text=text))


def judged(texts: list[str], paths: list[str], forest: Forest, threshold: float = THRESHOLD) -> list[list[tuple[int, int, str, float]]]:
    """start, end, kind, score of the chosen candidates of each text, in order and without overlaps."""
    found = [candidates(t) for t in texts]
    flat = [(i, s, e, k, m) for i, own in enumerate(found) for s, e, k, m in own]
    out: list[list] = [[] for _ in texts]
    if flat:
        p = forest.score(np.array([features(texts[i], s, e, m, paths[i], forest.dictionary) for i, s, e, _, m in flat], float))
        for (i, s, e, k, _), v in zip(flat, p.tolist(), strict=True):
            out[i].append((s, e, k, v))
    return [chosen(own, threshold) for own in out]


def scan(df: DataFrame, forest: Forest, *, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row per candidate: key, start, length (code points), kind, score, secret (kept after false-positive removal)."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch):
            texts, paths = texts_of(batch.column(1)), texts_of(batch.column(2))
            rows = [(i, *f) for i, own in enumerate(judged(texts, paths, forest, threshold)) for f in own]
            if rows:
                owner, start, end, kinds, score = zip(*rows, strict=True)
                start, end, score = np.array(start), np.array(end), np.array(score)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(end - start), pa.array(kinds), pa.array(score), pa.array(score >= threshold)], ["key", "start", "length", "kind", "score", "secret"])

        return each

    return map_rows(df.select(key, text, path), make, f"key {kind}, start long, length long, kind string, score double, secret boolean").withColumnRenamed("key", key)


def redact(df: DataFrame, forest: Forest, *, text: str = "text", path: str = "source", chars: str = "n_chars", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """df with found secrets replaced by a mark and the character count brought up to date; null texts stay null."""
    names = df.columns
    at, where, count = names.index(text), names.index(path), names.index(chars)

    def make():
        def each(batch: pa.RecordBatch):
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            counts = columns[count].to_pylist()
            for i, own in enumerate(judged([t or "" for t in texts], texts_of(batch.column(where)), forest, threshold)):
                spans = [(s, e) for s, e, _, p in own if p >= threshold]
                if spans:
                    for s, e in reversed(spans):
                        texts[i] = texts[i][:s] + mark + texts[i][e:]
                    counts[i] = len(texts[i])
            columns[at], columns[count] = pa.array(texts, pa.string()), pa.array(counts, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return each

    return map_rows(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
