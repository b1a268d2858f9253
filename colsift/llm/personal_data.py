"""Personal data: exact patterns, and spans that a conditional random field over word shapes adds to them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that does not begin a match has none further on, so only its first digit is tried: linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ sign outwards, so that long runs without one cost nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def digits_in(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind. Matches that fail their check are dropped; nothing is tried again within them."""
    if not MARK.search(text):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split("."))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(digits := digits_in(m[0])) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


# A small labelled table, as text: what is between brackets is a span of the kind before the bar.
LABELLED = """
call me at [phone|555-0134-88] after lunch
tel [phone|(030) 4455-6677] or mail [email|anna.k@mail.example.org] today
my number is [phone|0049-30-1234567] and the office is closed
ring [phone|+44 20 7946 0018] before 9 please
dial [phone|212.555.0147] for the desk
phone [phone|030/8765432] in the evening
the line [phone|(212) 555-0199] was busy
write to [email|bob@localhost] about it
send it to [email|jane(at)example.org] soon
reach [email|kim_lee@corp.example.com] or [phone|+1-202-555-0173] now
[email|first.last@uni.example.edu] wrote on 2024-05-17 about this
mail [email|o.neil@sub] and wait
host [ip|10.0.0.12] answered in 35 ms
the server at [ip|192.168.1.254] was down
login from [ip|172.16.254.1] port 22 failed
ping [ip|8.8.4.4] and [ip|203.0.113.77] twice
card [card|4111 1111 1111 1111] expires 12/27
paid with [card|5500-0000-0000-0004] yesterday
number [card|378282246310005] was refused
his card [card|6011 0009 9013 9424] is old
on 2024-05-17 we met at 10:30 in room 12
version 3.2.1 came out in 2023 with 145 fixes
the price was 1,299.00 and later 999.50
pages 12-48 of volume 3 from 1998
id 0b64f191 and 7a3e9c0d are keys
in 1984 there were 2,000,000 of them
about 35% of 120 people came by 9 am
see section 4.3 and table 17 for 2019
order 88123 has 3 items for 45.10
the 2nd and the 3rd of 10 runs took 5s
on 17.05.2024 at 08:15 it rained 12mm
chapter 7 verse 21 and note 1004
they sold 15000 in 2021 and 18000 in 2022
error 404 on line 1187 of file2
a plain line with no numbers at all
and then that is what was meant by them
score 3-1 after 90 minutes
it is 12 @ 3.50 each
x2 and y10 are names of 2 things
flight 1203 leaves 06:45 from gate 22
serial 4929 1203 8841 0077 is printed below
parcel 1234567890123456 left the depot
order 9876-5432-1098-7654 was sent out
batch 5500 0000 0000 0005 of the mill
the counter stood at 4111111111111112 then
invoice 20240517 and 30012345678901 are paid
amex [card|371449635398431] on file
visa [card|4222222222222] was charged
card number [card|30569309025904] please
pay by card [card|3056 930902 5904] today
release 10.4.300.2 fixed it
firmware 2.18.512.7 is out
build 7.1.0.4412 broke the test
the range 1.2 to 3.4 holds
my office line is [phone|030-2345678] until noon
call back on [phone|(0171) 555 0199] tonight
mobile [phone|0171-5550199] or landline [phone|089/123456]
fax [phone|0221-998877] and mail [email|office@firm]
his phone is [phone|555.0123.44] now
text me at [phone|07700-900123] later
contact [email|sam(at)mail.example.net] for it
email [email|team@intranet] with questions
mail to [email|lee[at]example.com] please
user @home and user @work were there
tweet by @someone at 10:15
scale 1:50000 and 2:1 were used
isbn 978-3-16-148410-0 is listed
row 12-34-56 of the sheet
score 112-98 in game 7
years 1914-1918 and 1939-1945
id 555-0134-88-A of the part
""".strip().splitlines()
STATES = ("other", *KINDS)
BITS = 14
EPOCHS = 200
PUNCTUATION = ".,;:!?\"'<>[]{}"
# Tokens whose class a worker remembers before it begins anew.
REMEMBERED = 100_000


def shape(token: str) -> str:
    """Letters become a or A, runs of them one; digits 9, up to six in a row; other signs stay."""
    out = []
    for c in token[:48]:
        k = "9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not (out and k == out[-1] and (k in "aA" or out[-6:] == ["9"] * 6)):
            out.append(k)
    return "".join(out) + ("*" if len(token) > 48 else "")


def hashed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest()) & ((1 << BITS) - 1)


def token_class(token: str, words: frozenset[str]) -> tuple[str, str, str]:
    """All that the model sees of a token: its shape, itself if it is one of the known ``words``, and whether many digits pass Luhn."""
    bare = token.strip(PUNCTUATION)
    word = bare.lower() if len(bare) <= 16 else ""
    digits = digits_in(bare) if len(bare) <= 64 else ""
    return shape(bare), word if word in words else "", str(luhn(digits)) if len(digits) >= 13 else ""


def own_features(kind: tuple[str, str, str]) -> list[int]:
    """Hashed features of a token's class: shape, its digits, signs, beginning and length, and the Luhn test."""
    s, word, passes = kind
    names = ("s" + s, "d" + str(s.count("9")), "c" + "".join(sorted({c for c in s if not c.isalnum()})), "f" + s[:2],
             "m" + str("@" in s) + str(s.count(".")) + str(s.count("-")), "l" + str(min(len(s), 12)), "w" + word, "k" + passes)
    return [hashed(n) for n in names]


def side_features(kind: tuple[str, str, str] | None, side: str) -> list[int]:
    """Hashed features that a token's neighbour on one side gives it; None is the end of the text."""
    s, word, _ = kind or ("end", "", "")
    return [hashed(side + s), hashed(side + side + word)]


def feature_ids(tokens: list[str], words: frozenset[str]) -> list[list[int]]:
    """All features of each token of a sequence."""
    kinds = [None, *(token_class(t, words) for t in tokens), None]
    return [own_features(kinds[i]) + side_features(kinds[i - 1], "p") + side_features(kinds[i + 1], "n") for i in range(1, len(kinds) - 1)]


@dataclass
class Crf:
    """Linear chain: a weight for each feature and state, and for each pair of states; ``words`` are those it knows."""

    weights: np.ndarray
    moves: np.ndarray
    words: frozenset[str]

    def vectors(self, kind: tuple[str, str, str] | None) -> np.ndarray:
        """What a class gives to its own token, to the one behind it and to the one before it, by state."""
        own = self.weights[own_features(kind)].sum(0) if kind else np.zeros(len(STATES))
        return np.stack([own, self.weights[side_features(kind, "p")].sum(0), self.weights[side_features(kind, "n")].sum(0)])

    def certain(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that are state other in every best sequence: there, no other state can win back by its moves what it loses by itself."""
        into = (self.moves - self.moves[:, :1]).max(0).clip(0)
        out = (self.moves - self.moves[:1]).max(1).clip(0)
        return (emit[:, :1] - emit[:, 1:] > (into + out)[1:]).all(1)


def labelled(lines: list[str] | None = None) -> list[tuple[list[str], list[int]]]:
    """Tokens and states of the labelled table."""
    rows = []
    for line in LABELLED if lines is None else lines:
        tokens, states = [], []
        for plain, kind, inside in re.findall(r"((?:[^\[]|\[(?!\w+\|))+)|\[(\w+)\|((?:[^\[\]]|\[\w+\])+)\]", line):
            words = (plain or inside).split()
            tokens += words
            states += [STATES.index(kind) if kind else 0] * len(words)
        rows.append((tokens, states))
    return rows


def padded(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of sequences as one array (sequence, place, feature), and their lengths."""
    lengths = np.array([len(r) for r in rows])
    ids = np.zeros((len(rows), lengths.max(), len(rows[0][0])), np.int32)
    for i, r in enumerate(rows):
        ids[i, : len(r)] = r
    return ids, lengths


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]] | None = None, epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood with a quadratic penalty by adaptive gradient steps over the whole table, forward-backward in numpy."""
    table = table or labelled()
    words = frozenset(w for t, _ in table for w in (x.strip(PUNCTUATION).lower() for x in t) if w.isalpha() and len(w) <= 16)
    ids, lengths = padded([feature_ids(t, words) for t, _ in table])
    n, longest, k = len(table), ids.shape[1], len(STATES)
    gold = np.zeros((n, longest, k))
    for i, (_, states) in enumerate(table):
        gold[i, np.arange(len(states)), states] = 1
    inside = np.arange(longest)[None, :] < lengths[:, None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    w, moves = np.zeros((1 << BITS, k)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(epochs):
        emit = w[ids].sum(2)
        ahead, back = np.zeros((longest, n, k)), np.zeros((longest, n, k))
        ahead[0] = emit[:, 0]
        for t in range(1, longest):
            step = log_sum(ahead[t - 1][:, :, None] + moves[None], 1) + emit[:, t]
            ahead[t] = np.where(inside[:, t, None], step, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            step = log_sum(moves[None] + (emit[:, t + 1] + back[t + 1])[:, None, :], 2)
            back[t] = np.where(inside[:, t + 1, None], step, 0)
        whole = log_sum(ahead[-1], 1)
        p = np.exp(ahead + back - whole[None, :, None]).transpose(1, 0, 2) * inside[:, :, None]
        pair = np.zeros((k, k))
        for t in range(longest - 1):
            both = ahead[t][:, :, None] + moves[None] + (emit[:, t + 1] + back[t + 1])[:, None, :] - whole[:, None, None]
            pair += (np.exp(both) * inside[:, t + 1, None, None]).sum(0)
        slope = np.zeros_like(w)
        np.add.at(slope, ids[inside], (gold - p)[inside][:, None, :])
        slope -= 0.01 * w
        move_slope = gold_moves - pair - 0.01 * moves
        gw += slope**2
        gm += move_slope**2
        w += 0.3 * slope / np.sqrt(gw)
        moves += 0.3 * move_slope / np.sqrt(gm)
    return Crf(w, moves, words)


def viterbi(rows: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best states of many sequences at once, each given by its scores (token, state); those of like length together."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        group = order[at : at + 4096]
        while len(group) > 1 and len(rows[group[-1]]) * len(group) > 1 << 17:
            group = group[: len(group) // 2]
        at += len(group)
        lengths = np.array([len(rows[i]) for i in group])
        emit = np.zeros((len(group), lengths.max(), len(STATES)))
        for j, i in enumerate(group):
            emit[j, : lengths[j]] = rows[i]
        came = np.zeros(emit.shape, np.int8)
        every = [emit[:, 0]]
        for t in range(1, emit.shape[1]):
            ways = every[-1][:, :, None] + moves[None]
            came[:, t] = ways.argmax(1)
            every.append(ways.max(1) + emit[:, t])
        last = np.stack(every, 1)[np.arange(len(group)), lengths - 1].argmax(1)
        states = np.zeros(emit.shape[:2], np.int8)
        states[np.arange(len(group)), lengths - 1] = last
        for t in range(emit.shape[1] - 1, 0, -1):
            states[:, t - 1] = np.where(t < lengths, came[np.arange(len(group)), t, states[:, t]], states[:, t - 1])
        for j, i in enumerate(group):
            out[i] = states[j, : lengths[j]]
    return out


class Tagger:
    """States of all tokens of texts. Chains are cut at tokens that are certainly other, which leaves the best sequence as it is."""

    def __init__(self, model: Crf):
        self.model, self.of, self.kinds, self.table = model, {}, {}, [model.vectors(None)]

    def classes(self, tokens: list[str]) -> np.ndarray:
        """Number of each token's class; 0 is the end of a text."""
        if len(self.of) > REMEMBERED or len(self.table) > REMEMBERED:
            self.of, self.kinds, self.table = {}, {}, self.table[:1]
        out = list(map(self.of.get, tokens))
        for i, found in enumerate(out):
            if found is None:
                kind = token_class(tokens[i], self.model.words)
                if kind not in self.kinds:
                    self.kinds[kind] = len(self.table)
                    self.table.append(self.model.vectors(kind))
                out[i] = self.of[tokens[i]] = self.kinds[kind]
        return np.array(out, np.int64)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores (token, state) of a whole text."""
        ends = np.concatenate(([0], self.classes(tokens), [0]))
        different, place = np.unique(ends, return_inverse=True)
        vectors = np.stack([self.table[i] for i in different])
        return vectors[place[1:-1], 0] + vectors[place[:-2], 1] + vectors[place[2:], 2]

    def states(self, texts: list[list[str]]) -> list[np.ndarray]:
        """States of all tokens of each text."""
        moves, pieces, places = self.model.moves, [], []
        out = [np.zeros(len(t), np.int8) for t in texts]
        for i, tokens in enumerate(texts):
            if not tokens:
                continue
            emit = self.emissions(tokens)
            open_at = np.flatnonzero(~self.model.certain(emit))
            for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1) if len(open_at) else []:
                scores = emit[run]
                if run[0] > 0:
                    scores[0] += moves[0]
                if run[-1] + 1 < len(tokens):
                    scores[-1] += moves[:, 0]
                pieces.append(scores), places.append((i, run))
        for (i, run), states in zip(places, viterbi(pieces, moves)):
            out[i][run] = states
        return out


def token_spans(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text, between ASCII white space, begin and end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = ((points >= 9) & (points <= 13)) | (points == 32)
    turn = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(turn == -1).tolist(), np.flatnonzero(turn == 1).tolist()


def added_spans(texts: list[str], bases: list[list[list[tuple[int, int]]]], tagger: Tagger) -> list[list[list[tuple[int, int]]]]:
    """Spans of each text that the model finds apart from the base ones: runs of tokens of one kind, without the punctuation around them.

    A span has a digit or an @ sign; texts without either have none and are not decoded.
    """
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in KINDS] for _ in texts]
    some = [i for i, t in enumerate(texts) if MARK.search(t)]
    spans = [token_spans(texts[i]) for i in some]
    found = tagger.states([[texts[i][a:b] for a, b in zip(*s)] for i, s in zip(some, spans)])
    for i, (starts, ends), states in zip(some, spans, found):
        taken = sorted(s for kind in bases[i] for s in kind)
        marked = np.flatnonzero(states)
        for run in np.split(marked, np.flatnonzero((np.diff(marked) > 1) | (np.diff(states[marked]) != 0)) + 1) if len(marked) else []:
            a, b = starts[run[0]], ends[run[-1]]
            piece = texts[i][a:b]
            a, b = a + len(piece) - len(piece.lstrip(PUNCTUATION)), b - len(piece) + len(piece.rstrip(PUNCTUATION))
            if b > a and MARK.search(texts[i], a, b) and not any(x < b and a < y for x, y in taken):
                out[i][states[run[0]] - 1].append((a, b))
    return out


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans) for a, b in sorted(found))


def personal_data(docs: DataFrame, model: Crf) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the exact patterns' spans; ``spans`` also has those the model adds, which never overlap them. Offsets are
    code points. A null text is empty: no spans. Repeated rows get the same result.
    """
    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def read(batches):
        tagger = Tagger(model)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, tagger)
            columns = {"doc_id": batch.column("doc_id")}
            for k, name in enumerate(KINDS):
                columns[f"n_{name}"] = pa.array([len(b[k]) for b in bases], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases])
            columns["spans"] = pa.array([joined([x + y for x, y in zip(b, m)]) for b, m in zip(bases, more)])
            columns["n_added"] = pa.array([sum(map(len, m)) for m in more], pa.int64())
            yield pa.record_batch(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, kind)
