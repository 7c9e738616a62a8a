"""Secrets: wide candidate patterns, and a random forest that removes false positives.

Candidates are long tokens of the characters that keys are made of, values assigned to a name, and private
key blocks. The forest judges each by its length, the transitions between kinds of characters, how much of it
common words cover, whether it looks like a path, and the words around it. It is trained on labelled
findings made up from a fixed seed. The base pattern of a key that names itself is a feature like others.

A null or empty text has no candidates. Offsets count code points, the end is exclusive; spans of a text
don't overlap: the longest stays, of equally long ones the first. Candidates have any length and are judged as a whole;
very long texts are read whole, in time that grows with their length. Repeated rows are read each. An empty table gives
an empty table. Only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, slices
from .trees import Trees, forest

LIMIT = 0.5
#: A token of this length or longer can be a key; after a name that tells of a secret, a shorter value too.
SHORTEST, ASSIGNED = 16, 8
TOKEN = re.compile(rf"[A-Za-z0-9_+/=.~-]{{{SHORTEST},}}")
VALUE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credentials?|contraseña|passwort|mot de passe)[\"']?\s{0,3}[:=]{1,2}>?\s{0,3}[\"']?([^\s\"'`,;]{8,})", re.I)
HINT = re.compile(r"pass|pwd|secret|token|key|auth|credential|contraseña|mot de", re.I)
#: A key block goes to its END line, whatever headers it has, but not past another BEGIN; without one, to the next hyphen.
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----|[^-]*)")
KNOWN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|gh[pousr]_[A-Za-z0-9]{20,}|glpat-|xox[abprs]-|sk[-_][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.|npm_[A-Za-z0-9]{20,}")
FOR = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials access private login passwort contraseña aws".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id ref url href src path file image version revision blob tree etag build".split())
COMMON = tuple(
    """the and ing tion ent ion her for tha ere ate con res ver all ons ter ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ell ant han ort
    ment able ness under over file data test user name path http https www com org html index image main build config service class function value string number list
    que les des ung ich ein der die sch cht ist ado cion para los est ent aire elle eux""".split()
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets, from left to right; of overlapping ones the longest."""
    spans = [m.span() for m in BLOCK.finditer(text)] if "-----BEGIN" in text else []
    if HINT.search(text):
        spans += [m.span(1) for m in VALUE.finditer(text)]
    for m in TOKEN.finditer(text):
        token = m.group()
        if not token.isalpha() and any(c.isalnum() for c in token):
            a, b = m.span()
            cut = token.rfind("=", 0, len(token.rstrip("=")))  # name=value
            spans.append((a + cut + 1, b) if 0 <= cut and b - a - cut - 1 >= ASSIGNED else (a, b))
    return sorted(apart(sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])), len(text))) if spans else []


#: Digit, lower case, upper case or other, of each ASCII character; others are other.
CLASS = np.array([0 if chr(c).isdigit() else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 for c in range(128)], np.int8)


def features(text: str, start: int, end: int) -> list[float]:
    """Of the whole candidate and what stands around it."""
    span = text[start:end]
    n = len(span)
    kinds = CLASS[np.minimum(np.frombuffer(span.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]
    changes = int(np.count_nonzero(kinds[1:] != kinds[:-1]))
    share = (np.bincount(kinds, minlength=4) / n).tolist()
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(span).values())
    low = span.lower()
    covered = bytearray(len(low))  # lower case may be longer
    for w in COMMON:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\1" * len(w)
            at = low.find(w, at + 1)
    vowels = sum(map(low.count, "aeiou"))
    runs = max((len(x) for x in re.findall(r"[a-z]+|[A-Z]+|[0-9]+", span)), default=0)
    before = text[max(0, start - 48) : start].lower()
    words = re.findall(r"[^\W\d_]+[0-9]*", before)[-4:]
    after = re.findall(r"[^\W\d_]+", text[end : end + 24].lower())[:2]
    hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span)
    return [
        n, math.log(n), changes / max(1, n - 1), *share, entropy, entropy / math.log2(max(2, n)), sum(covered) / n, vowels / n, runs / n,
        float(bool(hexed)), float(hexed is not None and n in (32, 40, 64)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", span))),
        span.count("/") / n, span.count(".") / n, span.count("-") / n, span.count("_") / n, float(bool(re.search(r"\.[a-z]{2,4}\Z", span))), float(span.startswith(("/", "./", "www.", "http"))),
        float(bool(KNOWN.match(span))), float(span.startswith("-----BEGIN")), float(any(w in FOR for w in words)), float(bool(words) and words[-1] in FOR), float(any(w in AGAINST for w in words)), float(any(w in FOR for w in after)),
        float(before.rstrip(" \"'").endswith(("=", ":", "=>"))), float(before.endswith(('"', "'", "`"))), float(before.endswith(("/", ".", "@", "//"))),
    ]


def _made_up(rng: np.random.Generator) -> tuple[str, str, str, bool]:
    """Text before, a finding, text after, and whether it is a secret."""
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, words = "0123456789abcdef", lambda k: [draw(low, int(rng.integers(3, 9))) for _ in range(k)]
    real = lambda k: [one(COMMON) + one(COMMON) for _ in range(k)]
    filler = " ".join(words(3)) + " "
    if rng.random() < 0.5:
        shape = int(rng.integers(8))
        if shape == 0:
            return filler + one(["", "key ", "aws_access_key_id = "]), one(["AKIA", "ASIA"]) + draw(up + dig, 16), " and", True
        if shape == 1:
            return filler + one(['token = "', "secret: ", "api_key='", "auth_token=", 'TOKEN="']), draw(hexes, one([24, 32, 40, 48, 64])), '" is', True
        if shape == 2:
            return filler + one(["password=", "password: ", "passwd = ", "pwd=", "secret="]), draw(one([hexes, low + dig, low + up + dig + "!#$%&*"]), int(rng.integers(9, 25))), " to", True
        if shape == 3:
            return filler, one(["ghp_", "gho_", "sk-", "sk_live_", "npm_", "xoxb-", "glpat-"]) + draw(low + up + dig, int(rng.integers(24, 44))), " in", True
        if shape == 4:
            return filler + one(["secret_key = ", "AWS_SECRET_ACCESS_KEY=", "private key: ", "Bearer ", "access key "]), draw(low + up + dig + "+/", 40), " for", True
        if shape == 5:
            return filler + one(["", "Authorization: Bearer ", "token "]), "eyJ" + draw(low + up + dig, 30) + "." + draw(low + up + dig, 40) + "." + draw(low + up + dig + "-_", 43), " x", True
        if shape == 6:
            return filler, "-----BEGIN RSA PRIVATE KEY-----\n" + draw(low + up + dig + "+/", 200) + "\n-----END RSA PRIVATE KEY-----", "\n", True
        return filler + one(["AIza key ", "key: "]), "AIza" + draw(low + up + dig + "-_", 35), " ok", True
    shape = int(rng.integers(10))
    if shape == 0:
        return filler + one(["commit ", "sha1: ", "checksum ", "md5 = ", "revision ", "sha256:", "etag "]), draw(hexes, one([32, 40, 64])), " and", False
    if shape == 1:
        return filler + one(["id ", "uuid: ", "guid=", "request "]), "-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12)), " of", False
    if shape == 2:
        return filler + one(["file ", "see ", "path: ", "https:"]), "/" + "/".join(real(int(rng.integers(2, 5)))) + one([".html", ".py", "/", ".png", "2.txt"]), " was", False
    if shape == 3:
        return filler, one(["_", "-", "."]).join(real(int(rng.integers(2, 4)))) + one(["", "2", "_v10"]), " the", False
    if shape == 4:
        return filler + one(["number ", "card ", "", "total "]), draw(dig, int(rng.integers(16, 22))), " on", False
    if shape == 5:
        return filler + one(["password: ", "password=", "token = ", "the secret: "]), one(["changeme", "required", "<password>", "********", "your-token-here", "$PASSWORD", "os.environ"]), " or", False
    if shape == 6:
        return filler, draw(low, int(rng.integers(3, 9))) + "." + draw(dig, 2) + one(["@", "."]) + ".".join(words(2)) + one([".com", ".org"]), " mail", False
    if shape == 7:
        return filler, "".join(w.title() for w in real(3)) + one(["", "2", "Test1"]), " class", False
    if shape == 8:
        word = "".join(real(int(rng.integers(3, 6))))
        return filler, (word.upper() if rng.random() < 0.5 else word) + one([".", "...", "-", "~"]), " so", False
    return filler, one(["=", "-", "_", "."]) * int(rng.integers(16, 40)) + "1", " end", False


@lru_cache(maxsize=2)
def model(findings: int = 4000, seed: int = 5) -> Trees:
    rng = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(findings):
        before, span, after, true = _made_up(rng)
        x.append(features(before + span + after, len(before), len(before) + len(span)))
        y.append(float(true))
    return forest(np.array(x), np.array(y))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, n_candidates and secrets: an array of (start, end, score)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model())  # bounded: the trees of a fixed number of findings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            spans = [candidates(x) for x in texts]
            x = np.array([features(t, *s) for t, own in zip(texts, spans) for s in own])
            scores = iter(trees.raw(x).tolist() if len(x) else ())
            out = [[{"start": a, "end": b, "score": p} for (a, b), p in zip(own, scores) if p >= limit] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, spans)), pa.int64()), pa.array(out, span)], names=["doc_id", "n_candidates", "secrets"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_candidates long, secrets array<struct<start:bigint,end:bigint,score:double>>")
