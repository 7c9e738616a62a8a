"""Personal data: fixed base patterns, and boosted trees over candidate spans.

Base spans (e-mail, IP, card, phone) are what the patterns find, leftmost and not overlapping within a kind,
after their checks. Generators with high recall read the whole text and propose more spans, from every start and
with several ends, so that they overlap: numbers that a base pattern lost because it ran on into its neighbour,
written-out e-mails, phone numbers without a plus sign, identity and account numbers, IPv6 and hardware
addresses. Candidates that overlap a base span are left out. Boosted trees judge the others by their format and by
the text around them. They learn from made-up findings of a fixed seed, put into passages of the documents
(CONTEXTS at most): a third fits the trees, a third the calibration of each kind, and a third its threshold, the
smallest probability at which PRECISION is reached. Of accepted spans that overlap, the likeliest stays; ties go to
the first, then the longest, then the first kind.

A null or empty text has no spans. Offsets count code points, the end is exclusive. Very long texts are read whole, in
time that grows with their length. Repeated rows are read each. An empty table gives an empty table. Only the two
named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, slices
from .trees import Isotonic, Trees, boosted

BASE = ("email", "ip", "card", "phone")
MORE = ("hidden_email", "local_phone", "national_id", "iban", "ipv6", "mac")
KINDS = (*BASE, *MORE)
#: Kinds that trees judge: those of MORE, and the base kinds whose patterns can lose a number.
JUDGED = ("card", "phone", *MORE)
PRECISION = 0.95
#: Passages of documents that made-up findings are put into, and their length; findings that are made up.
CONTEXTS, PASSAGE, FINDINGS = 2_000, 160, 12_000

LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind in the IP pattern keeps starts inside a run of digits from being tried in turn.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]+")
AT = re.compile(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?", re.I)
HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?)[A-Za-z0-9-]{1,63}){1,4}", re.I)
#: Forms of each kind. They hold no unbounded repeat, and are tried at every place of a text.
FORMS = {
    "card": [r"(?<![0-9])(?=((?:[0-9]{4}[ -]?){3}[0-9]{4})(?![0-9]))", r"(?<![0-9])(?=([0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9]))"],
    "phone": [rf"(?=(\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{{k}}})(?![0-9]))" for k in (1, 2, 3, 4)],
    "local_phone": [rf"(?<![0-9A-Za-z+.,$€£-])(?=(\(?[0-9]{{2,5}}\)?[ ./-]?[0-9]{{2,4}}(?:[ ./-]?[0-9]{{2,5}}){{{k}}})(?![0-9A-Za-z]))" for k in (1, 2, 3, 4)],
    "national_id": [r"(?<![0-9A-Za-z-])(?=([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9A-Za-z-]))"],
    "iban": [r"(?<![0-9A-Za-z])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z]))"],
    "ipv6": [r"(?<![0-9A-Za-z:])(?=((?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]))"],
    "mac": [r"(?<![0-9A-Za-z:-])(?=([0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5})(?![0-9A-Za-z:-]))"],
}
PROPOSED = [(KINDS.index(kind), re.compile(p), kind in ("ipv6", "mac")) for kind, forms in FORMS.items() for p in forms]
WORDS = {
    "card": "card visa mastercard credit carte tarjeta karte kreditkarte amex".split(),
    "phone": "phone tel telephone mobile cell call fax telefon handy anruf téléphone appelez teléfono llame".split(),
    "hidden_email": "mail e-mail email contact write reach kontakt correo courriel".split(),
    "local_phone": "phone tel telephone mobile cell call fax telefon handy anruf téléphone appelez teléfono llame".split(),
    "national_id": "ssn social security id identity passport national ausweis steuer sécurité identité dni seguro".split(),
    "iban": "iban account bank konto transfer compte cuenta banque banco".split(),
    "ipv6": "ip address host server adresse dirección".split(),
    "mac": "mac hardware device ethernet address adresse".split(),
}
AGAINST = frozenset("order invoice version page total price isbn issue ticket ref reference part model serie serial tracking date year build rev commit figure table room".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in their order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1) if done <= at else text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m.group())) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def proposed(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every candidate of the whole text."""
    found = set()
    done = 0
    for m in AT.finditer(text):
        name = m.start()
        while name > done and text[name - 1] in LOCAL:
            name -= 1
        done = m.end()
        if name < m.start() and (host := HOST.match(text, m.end())):
            found.add((KINDS.index("hidden_email"), name, host.end()))
    digits, colons = DIGIT.search(text) is not None, ":" in text or "-" in text
    for kind, pattern, hexed in PROPOSED:
        if colons if hexed else digits:
            found.update((kind, *m.span(1)) for m in pattern.finditer(text))
    return sorted(found)


def _mod97(span: str) -> bool:
    s = span.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, name = text[start:end], KINDS[kind]
    left, right = text[max(0, start - 2) : start], text[end : end + 2]
    before = re.findall(r"[^\W_]+(?:-[^\W_]+)?", text[max(0, start - 40) : start].lower())[-4:]
    after = re.findall(r"[^\W_]+", text[end : end + 30].lower())[:3]
    number = re.sub("[^0-9]", "", span)
    digits = len(number)
    groups = [len(g) for g in DIGIT.findall(span)] or [0]
    separators = [c for c in span if not c.isalnum()]
    year = bool(re.fullmatch(r"\(?(?:19|20)[0-9]{2}.*|.*[./-](?:19|20)[0-9]{2}", span))
    day = bool(re.fullmatch(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", span))
    return [
        *(float(kind == KINDS.index(k)) for k in JUDGED),
        len(span), digits, digits / len(span), len(groups), max(groups), min(groups), groups[-1], len(separators), len(set(separators)),
        float("." in separators), float("-" in separators), float("(" in separators), float(" " in separators),
        sum(c.isupper() for c in span), float(name == "iban" and _mod97(span)), float(name == "card" and luhn(number)), float(year), float(day),
        float(any(w in WORDS[name] for w in before)), float(any(w in WORDS[name] for w in after)),
        float(any(w in AGAINST for w in before)), float(any(w in v for k, v in WORDS.items() if k != name for w in before)),
        float(left.endswith((": ", "= ", ":", "=", "# ", "#", "° "))), float(start == 0 or text[start - 1].isspace()), float(end == len(text) or not text[end].isalnum()),
        float(bool(re.search(r"[0-9+][ .)/-]?\Z", left))), float(bool(re.match(r"[ .(/-]?[0-9]", right))), float(bool(re.match(r"[.(/-][0-9]", right)) or bool(re.search(r"[0-9][./-]\Z", left))),
        float(name == "national_id" and (span[:3] in ("000", "666") or span[0] == "9")), len({*span}) / len(span),
    ]


def _luhn_number(rng: np.random.Generator, right: bool) -> str:
    body = "".join(map(str, rng.integers(0, 10, 15)))
    last = next(d for d in "0123456789" if luhn(body + d))
    return body + (last if right else str((int(last) + int(rng.integers(1, 10))) % 10))


def _made_up(rng: np.random.Generator) -> tuple[str, str, str, str, bool]:
    """Text before, a finding, text after, its kind, and whether it is personal."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    octets = lambda k: ".".join(str(x) for x in rng.integers(0, 256, k))
    kind, true = one(JUDGED), bool(rng.random() < 0.5)
    tail = ""
    name, host = "".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(3, 9)))), one(["example", "mailbox", "post", "firma", "correo"])
    if kind == "hidden_email":
        good = f"{name}{one([' ', ''])}{one(['[at]', '(at)', '[ at ]', '{at}', '<AT>'])}{one([' ', ''])}{host}{one(['.', '[dot]', ' (dot) '])}{one(['com', 'org', 'de', 'es'])}"
        bad = f"{name}(at){number(2)}.{number(2)}"
    elif kind == "card":
        good, bad = _luhn_number(rng, True), _luhn_number(rng, False)
        if rng.random() < 0.5:
            sep = one(" -")
            good, bad = (sep.join(x[i : i + 4] for i in range(0, 16, 4)) for x in (good, bad))
    elif kind == "phone":
        country, area, a, b = one(["1", "44", "49", "33", "34"]), number(3), number(3), number(4)
        good = one([f"+{country} ({area}) {a}-{b}", f"+{country} {area} {a} {b}", f"+{country}-{area}-{a}-{b}", f"+{country} {number(2)} {number(4)} {number(4)}", f"+{country}{area}{number(3)}{b}"])
        bad = one([f"+{number(2)} {number(2)}", f"+{number(3)}.{number(2)}", f"+{number(1)} {number(3)}"])
    elif kind == "local_phone":
        area, a, b = number(3), number(3), number(4)
        good = one([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"0{number(3)} {number(6)}", f"0{number(2)}/{number(7)}", f"{area}.{a}.{b}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"])
        bad = one([number(int(rng.integers(7, 18))), f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.20{number(2)}", f"{number(2)} {number(3)} {number(3)}", f"{area}-{a}-{b}", f"{number(3)}.{number(2)}.{number(2)}"])
    elif kind == "national_id":
        good, bad = f"{rng.integers(100, 600)}-{number(2)}-{number(4)}", one([number(9), f"{number(3)} {number(2)} {number(4)}", f"9{number(2)}-{number(2)}-{number(4)}", f"{number(3)}-{number(2)}-{number(4)}"])
    elif kind == "iban":
        country, body = one(["DE", "FR", "ES", "GB", "NL"]), number(int(rng.integers(14, 22)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        good = f"{country}{check:02d}{body}"
        good = " ".join(good[i : i + 4] for i in range(0, len(good), 4)) if rng.random() < 0.5 else good
        bad = f"{one(['AB', 'SN', 'PO', 'DE'])}{number(2)}{number(int(rng.integers(8, 24)) // 4 * 4)}"
    elif kind == "ipv6":
        part = lambda: f"{int(rng.integers(0x1000, 0xFFFF)):x}"
        good, bad = ":".join(part() for _ in range(8)), one([":".join(number(2) for _ in range(int(rng.integers(4, 6)))), f"{number(1)}:{number(2)}:{number(2)}:{number(2)}"])
    else:
        part = lambda: f"{int(rng.integers(16, 256)):02x}"
        good, bad = one([":", "-"]).join(part() for _ in range(6)), "-".join(number(2) for _ in range(6))
    if kind in ("card", "phone"):  # what a base pattern leaves: a number that runs on into the next
        strange = {"card": [" " + number(4), " " + octets(4), "-" + number(2), " " + number(16)], "phone": [" " + octets(4), " " + number(16), " " + number(9), "." + number(6)]}[kind]
        tail = one(strange) if rng.random() < 0.8 else ""
        word = "" if rng.random() < 0.6 else one(WORDS[kind])
        return word + one([" ", ": "]) if word else "", good if true else bad, tail, kind, true
    plain = rng.random() >= (0.7 if true else 0.05)
    word = one(WORDS[kind]) if not plain else "" if true or rng.random() < 0.4 else one(sorted(AGAINST))
    if true and plain and kind in ("local_phone", "national_id") and not re.search(r"[() -]", good):
        word = one(WORDS[kind])
    return word + one([" ", ": ", " "]) if word else "", good if true else bad, tail, kind, true


@dataclass
class Judge:
    trees: Trees
    calibration: dict[int, Isotonic]
    limits: dict[int, float]

    def likely(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The calibrated probability of each candidate, or -1 if it is below its kind's threshold."""
        raw, out = self.trees.raw(x), np.full(len(x), -1.0)
        for k in np.unique(kinds).tolist():
            if k in self.limits:
                p = self.calibration[k](raw[kinds == k])
                out[kinds == k] = np.where(p >= self.limits[k], p, -1.0)
        return out


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = CONTEXTS) -> list[str]:
    """Passages from within documents, of the `most` with the least hashes of a share that holds about four times as many."""
    share = min(1.0, 4 * most / max(1, docs.count()))  # some more than are wanted, so that no task sorts many
    rows = docs.select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text")).filter("text <> ''")
    rows = rows.filter(F.pmod("h", F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length("text") - PASSAGE)) + 1
    rows = rows.select("h", F.substring(F.col("text"), at.cast("int"), F.lit(PASSAGE)).alias("p"))
    return [r.p for r in rows.orderBy("h", "p").limit(most).collect()]


def examples(contexts: list[str], findings: int = FINDINGS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and the number of the finding of all candidates around made-up findings.

    A finding stands between two words of a passage without digits, an @ or candidates. A candidate is true if it is a true finding of
    its own kind as a whole; one that is such a finding under another kind's name is left out.
    """
    rng = np.random.default_rng(seed)
    clean = [c for c in contexts if " " in c and not re.search(r"[0-9@]", c) and not proposed(c)] or ["in the and more of it"]
    x, y, kinds, of = [], [], [], []
    for i in range(findings):
        before, span, after, kind, true = _made_up(rng)
        carrier = clean[int(rng.integers(len(clean)))]
        spaces = [m.start() for m in re.finditer(" ", carrier)]
        at = spaces[int(rng.integers(len(spaces)))] + 1
        text = carrier[:at] + before + span + after + " " + carrier[at:]
        start = at + len(before)
        gold = (start, start + len(span))
        base = base_spans(text)
        for k, a, b in outside(text, base, proposed(text)):
            here = (a, b) == gold
            if here and KINDS[k] != kind and true:
                continue  # e.g. an identity number that is also a phone number
            x.append(features(text, k, a, b))
            y.append(float(true and here and KINDS[k] == kind))
            kinds.append(k)
            of.append(i)
    return np.array(x), np.array(y), np.array(kinds), np.array(of)


def judge(contexts: list[str], findings: int = FINDINGS, seed: int = 11) -> Judge:
    """Trees, calibrations and thresholds, each fitted on a third of the made-up findings."""
    x, y, kinds, of = examples(contexts, findings, seed)
    trees = boosted(x[of % 3 == 0], y[of % 3 == 0], rounds=60)
    raw, calibration, limits = trees.raw(x), {}, {}
    for k in map(KINDS.index, JUDGED):
        second, third = (kinds == k) & (of % 3 == 1), (kinds == k) & (of % 3 == 2)
        if not second.any():
            continue  # too few findings to know anything of this kind
        calibration[k] = Isotonic.fit(raw[second], y[second])
        p = calibration[k](raw[third])
        good = [t for t in np.unique(p) if t >= 0.5 and y[third][p >= t].mean() >= PRECISION]
        limits[k] = float(min(good, default=1.1))
    return Judge(trees, calibration, limits)


def outside(text: str, base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap no base span."""
    if not base or not spans:
        return spans
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    return [s for s in spans if taken.find(1, s[1], s[2]) < 0]


def all_spans(texts: list[str], judge: Judge) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """The base spans and the added ones of each text."""
    bases = [base_spans(t) for t in texts]
    spans = [outside(t, b, proposed(t)) for t, b in zip(texts, bases)]
    x = np.array([features(t, *s) for t, own in zip(texts, spans) for s in own])
    likely = judge.likely(x, np.array([s[0] for own in spans for s in own])).tolist() if len(x) else []
    out, at = [], 0
    for t, b, own in zip(texts, bases, spans):
        good = sorted((-p, a, -e, k) for (k, a, e), p in zip(own, likely[at : at + len(own)]) if p >= 0)
        at += len(own)
        out.append((b, sorted(apart([(k, a, -e) for _, a, e, k in good], len(t)))))
    return out


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
    shared = docs.sparkSession.sparkContext.broadcast(judge(passages(docs, doc_id, text)))  # bounded: 60 small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            pairs = all_spans([x or "" for x in batch.column("text").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([named(p[i]) for p in pairs], span) for i in (0, 1))], names=["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, base {kind}, added {kind}")
