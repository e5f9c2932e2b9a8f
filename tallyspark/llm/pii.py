"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans. The field reads islands: words that hold a digit, @ or = or announce an entity, with their
neighbours. Candidate segments are whole spans of up to MOST_TOKENS tokens between edges of words that could be an entity at all: groups
of digits and capitals, addresses, capitalised words, long words. Each is scored by features of the segment as a whole (numbers of
digits and letters, how they are grouped, checksums, what stands before it), and a dynamic programme over bounded segments chooses
boundaries and types together. Its weights are learned from generated sentences with known spans. Spans of the
field that touch a base span are dropped.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, texts

BASE = ("email", "ip", "card", "phone")
#: Types of the field; "other" covers one token that belongs to nothing.
TYPES = ("other", *BASE, "ssn", "iban", "secret", "passport", "street", "name")
#: Tokens in a segment (the bound of an entity), and characters in one of several tokens that is no announced secret. One token, or a secret, may be of any length.
MOST_TOKENS, MOST_CHARS = 24, 128
#: Words of an island before and after a word with a digit or a cue.
BEFORE, AFTER = 3, 4
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
address = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
card = re.compile(r"[0-9](?:[ -]?[0-9])++")
phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words that announce an entity without digits; they are looked for in lower case.
ANNOUNCE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "mr. ", "mrs. ", "ms. ", "dr. ", "herr ", "frau ", "madame ", "monsieur ", "señor ", "señora ", "name is ", "name: ")
announced = re.compile("(?i)(?=" + "|".join(map(re.escape, ANNOUNCE)) + ")")
hot = re.compile(r"[0-9@=]")
#: Letters of scripts without blanks between words (or with endings on numbers): they end a token like a blank does.
WIDE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
wide = re.compile(f"[{WIDE}]").match
token = re.compile(rf"[^\W_{WIDE}]+|(?:[{WIDE}](?<=\w))+|[^\w\s]|_")
word = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Every @ with local characters before it and a domain after it, from the left, without overlap."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = at + 1  # no local part reaches over this @
        at = text.find("@", at + 1 if not found else done)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start and order of kinds; of each kind leftmost matches that do not overlap."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in address.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in card.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in phone.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


# --- the field


def islands(text: str):
    """(start, end) of the words with a digit, @ or =, or that announce something, each with BEFORE words before and AFTER words after it;
    what touches is one island."""
    low = text.lower()
    marks = {m.start() for m in hot.finditer(text)}
    if len(low) == len(text):  # places are the same then
        for x in ANNOUNCE:
            at = low.find(x)
            while at >= 0:
                marks.add(at)
                at = low.find(x, at + len(x))
    else:
        marks.update(m.start() for m in announced.finditer(text))
    if not marks:
        return
    spans = [m.span() for m in word.finditer(text)]
    starts = [a for a, _ in spans]
    first = last = -1
    for k in sorted({bisect_right(starts, m) - 1 for m in marks}):
        if last >= 0 and k - BEFORE <= last + 1:
            last = min(len(spans) - 1, k + AFTER)
            continue
        if last >= 0:
            yield spans[first][0], spans[last][1]
        first, last = max(0, k - BEFORE), min(len(spans) - 1, k + AFTER)
    yield spans[first][0], spans[last][1]


iban_shape = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?").fullmatch
#: What a segment may look like: mail, groups of digits and capitals, one long word, a street with a number, capitalised words.
mail = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+").fullmatch
groups = re.compile(r"\+?\(?[A-Z0-9]++(?:[ ./()-]{1,3}+[A-Z0-9]++)*+").fullmatch
long_word = re.compile(r"[A-Za-z0-9+/_.=-]{8,}").fullmatch
street = re.compile(
    r"[0-9]{1,5}[a-zA-Z]? (?:[A-Z][a-z'-]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)"
    r"|[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|gasse|allee|platz) [0-9]{1,4}[a-z]?|[0-9]{1,4},? (?:rue|avenue|boulevard|chemin) (?:\w+[ '’-]){0,3}\w+|(?:[Cc]alle|[Aa]venida|[Pp]aseo) (?:\w+ ){0,2}\w+,? [0-9]{1,4}"
).fullmatch
_PART = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+(?:(?<=-)[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+)*"  # a capital may follow a hyphen
name = re.compile(rf"{_PART}(?: {_PART}){{0,2}}").fullmatch
#: What stands before an entity, by feature.
CUES = {
    "cue_secret": r"token|secret|password|passwd|passphrase|pwd|api[_ -]?key|key",
    "cue_ssn": r"ssn|social security|sozialversicherung|身份证号",
    "cue_phone": r"phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone",
    "cue_id": r"passport|passeport|pasaporte|reisepass|id card|licen[cs]e|dni|ausweis",
    "cue_account": r"iban|account|konto|compte|cuenta",
    "cue_name": r"mr|mrs|ms|dr|herr|frau|monsieur|madame|señor|señora|name",
}
cues = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in CUES.items()) + r")(?:[ :]+(?:number|no|nr|is|ist|est|es))?\W{0,4}$").search
#: Features of a whole segment.
FEATURES = (
    "bias", "tokens", "at_domain", "ip_shape", "card_shape", "phone_shape", "iban_shape", "iban_sum", "long_word", "mixed", "mostly_digits", "spaces_outside", "one_token", "cut_left", "cut_right", "at_more", "loose_stop",
    "no_digits", "digits_1_4", "digits_5_8", "digits_9", "digits_10", "digits_11_13", "digits_14", "grouped_324", "grouped_334", "grouped_422", "letters_then_digits", "assigned", "hex", "street_shape", "name_shape", "name_words", "under_10", *CUES,
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def iban_sum(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def cue_of(text: str, a: int) -> str:
    """The feature of what stands before a place, or an empty string."""
    found = cues(text[max(0, a - 40) : a])
    return found.lastgroup if found else ""


def segment(text: str, a: int, b: int, tokens: int, cue: str) -> tuple[int, ...]:
    """Places in FEATURES that hold for text[a:b]."""
    s = text[a:b]
    runs = re.findall("[0-9]+", s)
    digits = sum(map(len, runs))
    sizes = tuple(map(len, runs))
    letters = sum(map(str.isalpha, s))
    iban = bool(digits >= 2 and iban_shape(s))
    secret = bool(long_word(s))
    cut_left = a > 0 and text[a - 1].isalnum() and s[:1].isalnum() and not (wide(text[a - 1]) or wide(s))
    cut_right = b < len(text) and text[b].isalnum() and s[-1:].isalnum() and not (wide(text[b]) or wide(s[-1]))
    more = a > 0 and text[a - 1] in LOCAL or b + 1 < len(text) and text[b] in ".-" and text[b + 1].isalnum()
    named = bool(name(s))
    facts = (
        True, tokens > 4, "@" in s and bool(emails(s) == [(0, len(s))]), len(runs) == 4 and bool(address.fullmatch(s)), 14 <= digits <= 19 and bool(card.fullmatch(s)) and luhn(digits_of(s)),
        10 <= digits <= 15 and bool(phone.fullmatch(s)), iban, iban and iban_sum(s), secret and len(s) >= 16, secret and digits >= 4 and letters >= 4, 2 * digits > len(s), " " in s and not iban, tokens == 1, cut_left, cut_right, "@" in s and more, ". " in s or "  " in s or "\n" in s,
        digits == 0, 1 <= digits <= 4, 5 <= digits <= 8, digits == 9, digits == 10, 11 <= digits <= 13, digits >= 14, sizes == (3, 2, 4), sizes == (3, 3, 4), sizes in ((4, 2, 2), (2, 2, 4), (2, 2)), 1 <= letters <= 3 and len(runs) == 1 and s[-1:].isdigit() and 6 <= digits <= 9,
        cue == "cue_secret" and text[a - 1 : a] in tuple("=\"':") + (" ",) and any(c in "=:" for c in text[max(0, a - 4) : a]), secret and len(s) >= 16 and all(c in "0123456789abcdef" for c in s), digits > 0 and bool(street(s)), named, named and " " in s, len(s) < 10,
    )
    out = [i for i, f in enumerate(facts) if f]
    if cue:
        out.append(_AT[cue])
    return tuple(out)


def candidates(text: str, a: int, b: int):
    """For each token end, the candidate segments: first token, start, end, features. One end at a time, so that a long word needs no list of them.
    Longer segments than a token begin and end at edges of words and hold five digits, an @, or a street or a name that was announced."""
    spans = [m.span() for m in token.finditer(text, a, b)]
    digits = [0]
    for s, e in spans:
        digits.append(digits[-1] + sum("0" <= c <= "9" for c in text[s:e]))
    edge = [(s == 0 or not (text[s - 1].isalnum() or text[s - 1] == "_") or bool(wide(text[s - 1]))) and (text[s].isalnum() or text[s] in "+(") for s, _ in spans]
    cue = [cue_of(text, s) if g else "" for (s, _), g in zip(spans, edge, strict=True)]
    for j, (_, end) in enumerate(spans):
        found = []
        for i in range(max(0, j - MOST_TOKENS + 1), j + 1):
            start = spans[i][0]
            if i < j:
                if not edge[i] or cue[i] != "cue_secret" and end - start > MOST_CHARS or not text[end - 1].isalnum():
                    continue
                n = digits[j + 1] - digits[i]
                s = text[start:end]
                if not (n >= 5 and end - start <= 44 and groups(s) or "@" in s and mail(s) or cue[i] == "cue_secret" and long_word(s) or n and street(s) or cue[i] == "cue_name" and name(s) or n >= 4 and long_word(s)):
                    continue
            found.append((i, start, end, segment(text, start, end, j - i + 1, cue[i])))
        yield found


def lattice(text: str, a: int, b: int) -> list[list[tuple[int, int, int, tuple[int, ...]]]]:
    return list(candidates(text, a, b))


def best_types(weights: np.ndarray):
    """For a segment's features: the value of "other", the best other type and its value. Ties go to the earlier type. Remembered, since
    segments share few sets of features."""
    table = weights.tolist()

    @lru_cache(1 << 16)
    def of(facts: tuple[int, ...]) -> tuple[float, int, float]:
        values = [sum([w[f] for f in facts]) for w in table]
        y = max(range(1, len(values)), key=lambda k: (values[k], -k))
        return values[0], y, values[y]

    return of


def decode(rows, weights: np.ndarray, typed=None) -> list[tuple[int, int, str]]:
    """The best division into typed segments; only segments of one token can be "other". Ties go to the earlier type and the longer segment."""
    typed = typed or best_types(weights)
    best = [0.0]
    back: list = [None]
    for j, ends in enumerate(rows):
        most, how = -math.inf, None
        for i, a, b, facts in ends:
            other, y, value = typed(facts)
            if i == j and best[i] + other > most + 1e-12:
                most, how = best[i] + other, (i, a, b, 0)
            if best[i] + value > most + 1e-12:
                most, how = best[i] + value, (i, a, b, y)
        best.append(most)
        back.append(how)
    out, j = [], len(back) - 1
    while j:
        i, a, b, y = back[j]
        if y:
            out.append((a, b, TYPES[y]))
        j = i
    return out[::-1]


def gradient(rows, gold: set[tuple[int, int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the gold segments (start, end, type): observed less expected features."""
    n = len(rows)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0], backward[n] = 0.0, 0.0
    scores = [[(i, f, np.array([weights[y, list(f)].sum() if y or i == j else -np.inf for y in range(len(TYPES))])) for i, _, _, f in ends] for j, ends in enumerate(rows)]
    for j in range(n):
        forward[j + 1] = np.logaddexp.reduce(np.concatenate([forward[i] + s for i, _, s in scores[j]]))
    for j in range(n - 1, -1, -1):
        for i, _, s in scores[j]:
            backward[i] = np.logaddexp(backward[i], backward[j + 1] + np.logaddexp.reduce(s))
    out = np.zeros_like(weights)
    for j in range(n):
        for (i, f, s), (_, a, b, _) in zip(scores[j], rows[j], strict=True):
            p = np.exp(forward[i] + s + backward[j + 1] - forward[n])
            seen = np.array([(a, b, y) in gold for y in range(len(TYPES))], float)
            out[:, list(f)] += (seen - p)[:, None]
    return out


def sentences(count: int, seed: int = 5):
    """Generated islands with the spans they hold: (text, [(start, end, type)])."""
    rnd = random.Random(seed)
    pick = rnd.choice
    digit = lambda n: "".join(pick("0123456789") for _ in range(n))
    some = lambda letters, n: "".join(pick(letters) for _ in range(n))
    word = lambda: some("aeiounrstl", rnd.randint(2, 8))

    def make(kind: str) -> tuple[str, str, str]:
        if kind == "email":
            return "", f"{word()}.{digit(2)}@{word()}{digit(1)}.example.com", ""
        if kind == "ip":
            return "", ".".join(str(rnd.randint(0, 255)) for _ in range(4)), ""
        if kind == "card":
            body = digit(15)
            return "", next(body + c for c in "0123456789" if luhn(body + c)), ""
        if kind == "phone":
            return pick([("", f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", ""), ("", f"{digit(3)}-{digit(3)}-{digit(4)}", ""), (pick(["call ", "phone: ", "tel. "]), f"{digit(3)}{(x := pick(' .-'))}{digit(3)}{x}{digit(4)}", "")])
        if kind == "ssn":
            return pick([("", f"{digit(3)}-{digit(2)}-{digit(4)}", ""), (pick(["ssn ", "SSN: ", "social security number "]), pick([f"{digit(3)} {digit(2)} {digit(4)}", digit(9)]), "")])
        if kind == "iban":
            body = digit(18)
            code = f"DE{98 - int(body + '131400') % 97:02d}{body}"
            return pick(["", "iban "]), pick([code, " ".join(code[i : i + 4] for i in range(0, 22, 4))]), ""
        if kind == "secret":
            cue = pick(['token = "', "password=", "secret: ", 'api_key = "', "api_key=", 'token="'])
            return cue, pick([some("0123456789abcdef", pick([24, 32, 40])), some("abcdefghijklmnopqrstuvwxyz", rnd.randint(14, 30)), some("ABCDEFGHIJKLMabcdefghijklm0123456789", pick([20, 64, 140, 200]))]), ""
        if kind == "passport":
            return pick(["passport ", "passport no. ", "Reisepass ", "pasaporte: "]), some("CFGHXZ", pick([1, 2])) + digit(7), ""
        if kind == "street":
            cap = word().title()
            return "", pick([f"{rnd.randint(1, 999)} {cap} {pick(['Street', 'Road', 'Avenue', 'Lane'])}", f"{cap}{pick(['straße', 'gasse', 'allee'])} {rnd.randint(1, 200)}", f"{rnd.randint(1, 200)} rue {word()} {cap}", f"Calle {cap}, {rnd.randint(1, 200)}"]), ""
        if kind == "name":
            return pick(["Mr. ", "Mrs. ", "my name is ", "Herr ", "Dr. "]), " ".join(word().title() for _ in range(rnd.randint(1, 2))), ""
        return pick([
            (digit(rnd.randint(1, 7)), "", ""), (f"{digit(4)}-{digit(2)}-{digit(2)}", "", ""), (f"{digit(2)}:{digit(2)}", "", ""), (f"v{digit(1)}.{digit(1)}.{digit(1)}", "", ""), (f"@{word()}", "", ""), (f"{word()}={digit(2)}", "", ""), (f"{word()}{digit(2)}{word()}", "", ""), (digit(16), "", ""), (some("0123456789abcdef", 32), "", ""),
            (f"{digit(4)}-{digit(4)}", "", ""), (f"{digit(3)} {digit(3)} {digit(3)}", "", ""), (digit(9), "", ""), (digit(10), "", ""), (f"{some('ABCDEF', 1)}{digit(7)}", "", ""), (f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", "", ""), (f"{digit(2)} {word().title()} {word()}", "", ""), (f"{word().title()} {word().title()} {digit(2)}", "", ""), (f"{word()}={word()}", "", ""), (f"{digit(1)} {digit(2)} {digit(1)} {digit(3)}", "", ""), (f"{pick(['key', 'token', 'secret', 'password'])}{pick([' ', ': ', ' = ', '=', ' is '])}{word()}", "", ""), (f"{pick(['key', 'token'])}: {word()} {word()}", "", ""), (some("abcdefghijklmnop", 24), "", ""),
        ])

    for _ in range(count):
        text, gold = word() + " ", []
        for _ in range(rnd.randint(1, 2)):
            kind = pick([*TYPES[1:], *["other"] * 5])
            before, span, after = make(kind)
            text += before
            if span:
                gold.append((len(text), len(text) + len(span), TYPES.index(kind)))
            text += span + after + pick(["", ".", ",", "***", '"']) + " "
            if rnd.random() < 0.5:
                text += word() + " "
        yield text.rstrip(), gold


def total(values: list[float]) -> float:
    """The logarithm of the sum of the exponentials."""
    most = max(values)
    return most + math.log(sum([math.exp(v - most) for v in values])) if most > -math.inf else most


class Sample:
    """Sentences with their segments in one table, so that a step scores all of them by one product of matrices; sums over divisions go sentence by sentence."""

    def __init__(self, data):
        self.ends, self.starts, facts, single, gold = [], [], [], [], []
        for rows, wanted in data:
            ends, starts = [], [[] for _ in rows]
            for j, found in enumerate(rows):
                ends.append([])
                for i, a, b, places in found:
                    ends[-1].append((i, len(facts)))
                    starts[i].append((j, len(facts)))
                    facts.append(places)
                    single.append(i == j)
                    gold.append([(a, b, y) in wanted for y in range(len(TYPES))])
            self.ends.append(ends)
            self.starts.append(starts)
        self.x = np.zeros((len(facts), len(FEATURES)))
        for k, places in enumerate(facts):
            self.x[k, list(places)] = 1
        self.single, self.gold = np.array(single, bool), np.array(gold, float)

    def gradient(self, weights: np.ndarray) -> np.ndarray:
        """The sum of `gradient` over the sentences."""
        value = self.x @ weights.T
        value[~self.single, 0] = -np.inf
        most = value.max(1)
        whole = most + np.log(np.exp(value - most[:, None]).sum(1))
        s, share = whole.tolist(), np.zeros(len(whole))
        for ends, starts in zip(self.ends, self.starts, strict=True):
            n = len(ends)
            forward, backward = [0.0], [0.0] * (n + 1)
            for found in ends:
                forward.append(total([forward[i] + s[k] for i, k in found]))
            for i in range(n - 1, -1, -1):
                backward[i] = total([backward[j + 1] + s[k] for j, k in starts[i]]) if starts[i] else -math.inf
            for j, found in enumerate(ends):
                for i, k in found:
                    share[k] = forward[i] + s[k] + backward[j + 1] - forward[n]
        return (self.gold - np.exp(value - whole[:, None] + share[:, None])).T @ self.x


@lru_cache(1)
def learned(count: int = 240, steps: int = 25, l2: float = 0.005) -> tuple:
    """Weights by type and feature, the same at each call: gradient ascent from 0 on generated sentences."""
    weights = np.zeros((len(TYPES), len(FEATURES)))
    data = []
    for text, spans in sentences(count):
        rows = lattice(text, 0, len(text))
        gold = set(spans)
        for ends in rows:
            i, a, b, _ = ends[-1]
            if not any(s < b and a < e for s, e, _ in spans):
                gold.add((a, b, 0))
        data.append((rows, gold))
    sample, speed = Sample(data), np.zeros_like(weights)
    for _ in range(steps):
        g = sample.gradient(weights) / len(data) - l2 * weights
        speed += g * g
        weights += 1.0 * g / np.sqrt(speed + 1e-8)
    return tuple(map(tuple, weights))


def find(text: str, weights: np.ndarray, typed=None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start."""
    base = base_spans(text) if hot.search(text) else []
    more = [x for a, b in islands(text) for x in decode(candidates(text, a, b), weights, typed)]
    if base:
        more = [(s, e, y) for s, e, y in more if not any(s < q and p < e for p, q, _ in base)]
    order = {k: i for i, k in enumerate(TYPES)}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans of each row.

    Places are code points, ends exclusive. A null text is an empty one, without spans. Repeated rows and
    null ids give a row each; whole texts are read, in time linear in their length; an empty table gives no rows; other columns are ignored.
    """
    weights = np.array(learned())

    def run(batches):
        typed = best_types(weights)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                base, every = find(text, weights, typed)
                kinds = [x[2] for x in base]
                rows.append((doc, *(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            types = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)


def masked(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets, as <EMAIL>; of spans that overlap the first to begin. Null stays null,
    an empty text empty."""
    weights = np.array(learned())

    def mask(x: str, typed) -> str:
        out, at = [], 0
        for a, b, kind in find(x, weights, typed)[1]:
            if b > at:
                out += [x[at : max(a, at)], f"<{kind.upper()}>"] if a >= at else []
                at = b
        return "".join([*out, x[at:]])

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        typed = best_types(weights)
        return column.map(lambda x: mask(x, typed), na_action="ignore")

    return run(text)
