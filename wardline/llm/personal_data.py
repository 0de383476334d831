"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  The field labels every token with a digit or an at sign from its shape, the words around
it and, where it has one, a passing checksum; what the patterns found is evidence about other tokens, never a feature.
Neighbours share chain potentials, and all repeats of a token in a document are tied by skip potentials to one shared
node (a hub), so what is recognised in one place is also found where its context is missing, however many repeats lie
between.  Loopy message passing settles each document's labels.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.frames import SPACES, append_struct, fresh, narrow, numbered, quoted

# The kinds in order, their patterns (each written so that a failed start is not tried again inside it).
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACES = frozenset(SPACES)
# The names that a credential is assigned to, and the form of one; found spans teach the field a fifth kind.
SECRET = "secret"
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?[\x20\t]{0,4}[:=]"
                     r"[\x20\t]{0,4}[\"']?([a-z0-9_+/=-]{16,}+)")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_WORD_ENDS = ".,;:!?\"'()[]{}<>"

# Documents the field is fitted on and the most tokens that one of them may have; steps of its fit, their length and the
# number of sightings that halves it; rounds of messages beyond two for each node; certainty of an added span.
SAMPLE, MOST, STEPS, RATE, RARE, ROUNDS, CERTAIN = 3000, 100, 200, 0.2, 5.0, 40, 0.9
# Least characters of a word whose repeats are tied (a lone "12" says nothing of another), and the score for equal labels
# that ties start from; the fit moves it.
TIED, SAME = 5, 4.0
# Labels: 0 is none.  The feature numbered FEATURES is the empty one, without weight; SURE is the score of what is known.
ALL_KINDS = (*KINDS, SECRET)
FEATURES, WIDTH, LABELS, SURE = 1 << 14, 9, len(ALL_KINDS) + 1, 1e4


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _card(m: re.Match) -> bool:
    if m.end() - m.start() > 40:
        return False
    digits = _NOT_DIGIT.sub("", m[0])
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card(m)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of credentials assigned to a name that says so."""
    return [(len(KINDS), *m.span(1)) for m in _SECRET.finditer(text) if _DIGIT.search(text, *m.span(1))]


def unsure_spans(text: str) -> list[tuple[int, int, int]]:
    """Where a phone number runs on into other digits, so that its match fails: not evidence against one."""
    if "+" not in text:
        return []
    return [(0, *m.span()) for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) > 15]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans of the words that have a digit or an at sign, without punctuation at their ends."""
    out, last = [], 0
    for m in _DIGIT.finditer(text):
        if m.start() < last:
            continue
        start = end = m.start()
        while start > last and text[start - 1] not in _SPACES:
            start -= 1
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        last = end
        while start < end and text[start] not in "+(" and not text[start].isalnum():
            start += 1
        while start < end and text[end - 1] != ")" and not text[end - 1].isalnum():
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _shape(token: str) -> str:
    """Runs of digits with their lengths, runs of letters without, all else as it is."""
    return _RUN.sub(lambda m: f"9{len(m[0])}," if m[0][0] in "0123456789" else "a", token)


def _make(token: str) -> str:
    """What a token is made of, and its length by powers of two."""
    hexed = all(c in "0123456789abcdefABCDEF" for c in token)
    return f"{any(c.isalpha() for c in token)}{hexed}{len(token).bit_length()}"


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@dataclass
class Graph:
    """One document's tokens: spans, feature numbers (a row of WIDTH for each node), and edges (chain 0, skip 1).

    Hubs are nodes numbered after the tokens, one for each set of tokens that repeat a word; skip edges go from hub to token.
    """
    spans: list[tuple[int, int]]
    features: np.ndarray
    edges: np.ndarray
    hubs: int = 0


def graph_of(text: str) -> Graph:
    """The graph of a text.  Features of a token: its shape, alone and with that of the token beside it, its digits, what
    it is made of, two words before and one after, and (last) a passing checksum."""
    spans = tokens_of(text)
    shapes = [_shape(text[a:b]) for a, b in spans]
    features, edges, seen = array("i"), array("q"), {}
    for i, (a, b) in enumerate(spans):
        beside = i > 0 and a - spans[i - 1][1] <= 2
        before = shapes[i - 1] if beside else "-"
        after = shapes[i + 1] if i + 1 < len(spans) and spans[i + 1][0] - b <= 2 else "-"
        digits = _NOT_DIGIT.sub("", text[a:b])
        left = [w.strip(_WORD_ENDS).lower() for w in text[max(0, a - 64):a].split()[-2:]]
        right = [w.strip(_WORD_ENDS).lower() for w in text[b:b + 64].split(maxsplit=2)[:2]]
        right = next((w for w in right if w), "")
        left = ["", "", *left]
        names = (f"s{shapes[i]}", f"b{before}|{shapes[i]}", f"a{shapes[i]}|{after}", f"n{min(len(digits), 20)}", f"m{_make(text[a:b])}",
                 f"u{left[-1]}", f"v{left[-2]}", f"w{right}")
        features.extend(_number(n) for n in names)
        features.append(_number("checksum") if 13 <= len(digits) <= 19 and luhn(digits) else FEATURES)
        if beside:
            edges.extend((i - 1, i, 0))
        # Equal words, and words with the same digits if they are many.
        if b - a >= TIED:
            for key in {text[a:b].lower(), digits if len(digits) >= 6 else text[a:b].lower()}:
                seen.setdefault(key, []).append(i)
    tied = list(dict.fromkeys(tuple(m) for m in seen.values() if len(m) > 1))
    for h, members in enumerate(tied):
        for i in members:
            edges.extend((len(spans) + h, i, 1))
    features.extend([FEATURES] * (WIDTH * len(tied)))
    return Graph(spans, np.array(features, np.int32).reshape(-1, WIDTH), np.array(edges, np.int64).reshape(-1, 3), len(tied))


def hub_labels(graph: Graph, labels: np.ndarray) -> np.ndarray:
    """The label of each hub: the one that most of its recognised tokens have, 0 if none is recognised."""
    skip = graph.edges[graph.edges[:, 2] == 1]
    votes = np.zeros((graph.hubs, LABELS), np.int64)
    np.add.at(votes, (skip[:, 0] - len(graph.spans), labels[skip[:, 1]]), 1)
    votes[:, 0] = 0
    return votes.argmax(axis=1)


def base_labels(graph: Graph, spans: list[tuple[int, int, int]]) -> np.ndarray:
    labels = np.zeros(len(graph.spans), np.int64)
    ordered = sorted((a, b, k) for k, a, b in spans)
    i = 0
    for t, (a, b) in enumerate(graph.spans):
        while i < len(ordered) and ordered[i][1] <= a:
            i += 1
        for x, y, k in ordered[i:i + len(ALL_KINDS)]:
            if x < b and y > a:
                labels[t] = k + 1
                break
    return labels


@dataclass
class Field:
    nodes: np.ndarray
    pairs: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), LABELS))
        for column in features.T:
            out += self.nodes[column]
        return out

    def marginals(self, graph: Graph, taken: np.ndarray) -> np.ndarray:
        """Label probabilities of the tokens once messages along all edges, both ways at once, settle.

        ``taken`` are the labels known beforehand (0: unknown): these tokens are held at them, and a hub with such a token has
        the label of most of them.  Damped messages cross the graph in about two rounds a node at most, which bounds the rounds.
        """
        node = self.scores(graph.features)
        held = np.flatnonzero(taken)
        node[held, taken[held]] += SURE
        known = hub_labels(graph, taken)
        node[len(graph.spans) + np.flatnonzero(known), known[known > 0]] += SURE
        if not len(graph.edges):
            return _softmax(node)
        source = np.concatenate([graph.edges[:, 0], graph.edges[:, 1]])
        sink = np.concatenate([graph.edges[:, 1], graph.edges[:, 0]])
        tie = self.pairs[graph.edges[:, 2]]
        tie = np.concatenate([tie, tie.transpose(0, 2, 1)])
        half, sent = len(graph.edges), np.zeros((len(source), LABELS))
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        for _ in range(2 * len(node) + ROUNDS):
            belief = node.copy()
            np.add.at(belief, sink, sent)
            score = (belief[source] - sent[back])[:, :, None] + tie
            top = score.max(axis=1)
            new = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved, sent = np.abs(new - sent).max(), 0.5 * (new + sent)
            if moved < 1e-5:
                break
        belief = node.copy()
        np.add.at(belief, sink, sent)
        return _softmax(belief[:len(graph.spans)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Example:
    """A graph with its labels, for the fit: those of hubs follow those of tokens; -1 is not known."""
    features: np.ndarray
    labels: np.ndarray
    edges: np.ndarray


def example(text: str) -> Example:
    """The labels that patterns give to a text's tokens.

    Where no pattern matches, repeats of a recognised word and numbers that ran into others are unknown, not none.  The checksum of
    every other word, by its hash, is hidden, so that the field also learns to do without it.
    """
    graph = graph_of(text)
    known = base_labels(graph, base_spans(text) + secrets(text))
    hubs = hub_labels(graph, known)
    unsure = base_labels(graph, unsure_spans(text)) > 0
    skip = graph.edges[graph.edges[:, 2] == 1]
    unsure[skip[hubs[skip[:, 0] - len(known)] > 0, 1]] = True
    unsure &= known == 0
    seed = zlib.crc32(text.encode())
    hidden = [zlib.crc32(text[a:b].lower().encode(), seed) & 1 for a, b in graph.spans]
    graph.features[:len(hidden)][np.array(hidden, bool), -1] = FEATURES
    labels = np.concatenate([np.where(unsure, -1, known), hubs])
    return Example(graph.features, labels, graph.edges)


def fit(examples: list[Example]) -> Field:
    """Weights by pseudo-likelihood: each token's label given its features and the labels tied to it.

    Tokens of unknown label, and edges to them, are left out.  Steps of rarely seen features are shorter.
    """
    field = Field(np.zeros((FEATURES + 1, LABELS)), np.array([np.zeros((LABELS, LABELS)), SAME * np.eye(LABELS)]))
    field.nodes[:FEATURES, 0] = 0.2
    examples = [x for x in examples if len(x.features)]
    if not examples:
        return field
    starts = np.cumsum([0, *(len(x.features) for x in examples[:-1])])
    f, y = np.concatenate([x.features for x in examples]), np.concatenate([x.labels for x in examples])
    e = np.concatenate([x.edges + np.array([n, n, 0]) for x, n in zip(examples, starts)])
    e = e[(y[e[:, 0]] >= 0) & (y[e[:, 1]] >= 0)]
    told = (y >= 0)[:, None]
    one = np.eye(LABELS)[np.maximum(y, 0)]
    seen = np.bincount(f[told[:, 0]].ravel(), minlength=FEATURES + 1)[:, None] + RARE
    ties = np.bincount(e[:, 2], minlength=2)[:, None, None] + RARE
    for _ in range(STEPS):
        score = field.scores(f)
        np.add.at(score, e[:, 1], field.pairs[e[:, 2], y[e[:, 0]]])
        np.add.at(score, e[:, 0], field.pairs[e[:, 2], :, y[e[:, 1]]])
        miss = (one - _softmax(score)) * told
        step = np.zeros_like(field.nodes)
        for column in f.T:
            np.add.at(step, column, miss)
        pull = np.zeros_like(field.pairs)
        np.add.at(pull, (e[:, 2], y[e[:, 0]]), miss[e[:, 1]])
        np.add.at(pull.transpose(0, 2, 1), (e[:, 2], y[e[:, 1]]), miss[e[:, 0]])
        step[FEATURES] = 0
        field.nodes += RATE * step / seen
        field.pairs += RATE * pull / ties
    return field


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field fitted to what patterns say of at most ``sample`` different texts, those of least hash.

    Only texts that have tokens count, and of those only texts of at most ``MOST`` tokens are used, which bounds what reaches the
    driver: feature numbers, labels and edges.  Texts themselves are read where they lie.  Null and empty texts have no
    tokens; without any text the field adds nothing.
    """
    rows = docs.select(F.col(quoted(text_col)).alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    limit = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return fit([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = example(text)
                if 0 < len(got.features) and sum(got.features[:, 0] < FEATURES) <= MOST:
                    out.append((h, got.features.tobytes(), got.labels.astype(np.int8).tobytes(), got.edges.tobytes()))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(("h", "f", "y", "e"), r)) for r in out[i:i + 64]],
                                                 schema=pa.schema([("h", pa.int64())] + [(c, pa.binary()) for c in "fye"]))
    got = (rows.filter(F.col("h") <= limit).mapInArrow(run, "h long, f binary, y binary, e binary")
           .groupBy("h").agg(*(F.min(c).alias(c) for c in "fye")).collect())
    return fit([Example(np.frombuffer(r["f"], np.int32).reshape(-1, WIDTH), np.frombuffer(r["y"], np.int8).astype(np.int64),
                        np.frombuffer(r["e"], np.int64).reshape(-1, 3)) for r in sorted(got, key=lambda r: r["h"])])


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Assigned secrets, and spans of tokens labelled with certainty that touch no span known beforehand; neighbours of one kind
    join if a blank parts them."""
    graph = graph_of(text)
    if not graph.spans:
        return []
    given = [s for s in secrets(text) if not any(a < s[2] and b > s[1] for _, a, b in base)]
    taken = base_labels(graph, base + given)
    chance = field.marginals(graph, taken)
    label = np.where((chance.max(axis=1) >= CERTAIN) & (taken == 0), chance.argmax(axis=1), 0)
    out: list[list[int]] = []
    for i, k in enumerate(label):
        if k:
            a, b = graph.spans[i]
            if out and i and label[i - 1] == k and a - graph.spans[i - 1][1] == 1:
                out[-1][2] = b
            else:
                out.append([int(k) - 1, a, b])
    return given + [tuple(s) for s in out]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FIELDS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
                       + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
                          T.StructField("n_spans", T.LongType())])


def marked(docs: DataFrame, field: Field, text_col: str = "text", name: str = "personal") -> DataFrame:
    """``docs`` with a struct of the base counts, the base spans and all spans (``kind:start:end`` in code points)."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index(text_col)

    def compute(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(place).to_pylist():
            base = base_spans(text or "")
            spans = base + added_spans(text or "", held.value, base)
            counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
            out.append((*counts, spans_text(base), spans_text(spans), len(spans)))
        return dict(zip(_FIELDS.fieldNames(), zip(*out)))
    return append_struct(docs, fresh(docs, name), _FIELDS, compute)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id``, counts of base spans by kind, ``base`` and ``spans``, and ``n_spans`` of the latter.

    Spans beyond the base ones may also be of kind ``secret`` (credentials assigned to a name that says so, and their repeats).
    Null and empty text has none; repeated rows are judged each; a null id stays null; an empty table gives an empty
    result; other columns are ignored.  Added spans never touch base ones.
    """
    slim = narrow(docs, id_col, text_col)
    return marked(slim, learn(slim, sample=sample)).select("doc_id", "personal.*")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets."""
    out = marked(docs, learn(docs, text_col, sample), text_col)
    name = out.columns[-1]
    place, mark = out.columns.index(text_col), out.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, got in zip(batch.column(place).to_pylist(), batch.column(mark).to_pylist()):
                spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in got["spans"].split(",") if s))
                kept, last = [], 0
                for a, b, k in spans:
                    if b > last:
                        kept += [(text or "")[last:a], f"[{k}]"]
                        last = b
                texts.append(text if text is None else "".join([*kept, text[last:]]))
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns[:mark], names=batch.schema.names[:mark])
    return numbered(out).mapInArrow(run, numbered(docs).schema).toDF(*docs.columns)
