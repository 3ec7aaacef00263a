"""Log-bilinear language model: counts over the whole corpus, noise-contrastive training, normalised scores.

Each of the `HEAD` most frequent words is a unit with its own vectors, as target and as context. A rarer word belongs to one of
`OTHERS` classes by its last two bytes and to a leaf of that class by its hash; a leaf is a unit. The number of leaves follows the
number of rarer words up to `LEAVES` a class. The end of a text is a unit. The model predicts the next unit from the two before it by
a class - the end, one of the `ALONE` most frequent words, a group of the other head words by their endings, or a class of rarer
words - and the unit inside the class. Both are chosen in two steps of few choices each: a section of neighbouring classes and
the class in it, a shelf of `SHELF` neighbouring units and the unit on it. Each step scores products of the context vector
R[h1] * c1 + R[h2] * c2 (elementwise) with a vector plus a bias, and each is normalised exactly. Within a leaf a word has its share of
the counts.

Training is one pass over all training tokens: every task runs noise-contrastive estimation for all steps (noise: the frequencies of
all sections and of all classes of a section, each weighed by its share; of the shelves of a class and the units of a shelf, drawn
for each token) on its own texts from the same start, and Spark averages the vectors of each unit and shelf by the times a task
moved them. Counts are one aggregate over all training words. Only the `HEAD` most frequent words travel to the tasks; the rare
words of a text meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm import bytetext
from hindcast.llm.columns import pack, packed, unpack
from hindcast.sources.scratch import materialise

HEAD = 65_536
ALONE = 127
GROUPS = 192
OTHERS = 24
LEAVES = 2048
PER_LEAF = 8  # words of a leaf, as long as LEAVES allows
SECTION = 18  # classes
SHELF = 48  # units, at most
SMOOTH = 0.1
SIZE = 24
NOISE = 24
INNER = 4
BATCH = 4096  # tokens of the first batches
GROW = 8  # a later batch is this part of the tokens seen, a chunk at most
BLOCK = 256
SCORED = 2 << 20  # bytes of text counted or scored together
RATE = 0.1
END = ""  # no word is empty
LN10 = np.log(10.0)


def _suffix_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 .. OTHERS - 1 from the last two bytes of a word."""
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before) % OTHERS


def _leaf(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """0 .. OTHERS * width - 1: the leaf of a word, were it rare."""
    return _suffix_class(data, starts, ends) * width + (hashes >> np.uint64(20)).astype(np.int64) % width


def leaf_of(width: int):
    @F.arrow_udf(T.IntegerType())
    def leaf(words: pa.Array) -> pa.Array:
        """The leaf of a word (not empty)."""
        data, offsets = bytetext.string_bytes(words)
        starts, ends = offsets[:-1], offsets[1:]
        return pa.array(_leaf(data, starts, ends, bytetext.word_hashes(data, starts, ends), width).astype(np.int32))

    return leaf


def _guide(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys, slots).astype(np.int32)


def _seek(keys: np.ndarray, guide: np.ndarray, slot: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """`searchsorted` of keys, from the place that the guide has for the slot of each value (len(keys) - 1 at most)."""
    at = guide.take(slot).astype(np.int64)
    for _ in range(2):
        at += keys.take(at, mode="clip") < wanted
    late = np.flatnonzero(keys.take(at, mode="clip") < wanted)
    at[late] = np.searchsorted(keys, wanted[late])
    return np.minimum(at, len(keys) - 1)


class Level:
    """The choices of a step side by side, with their frequencies: those below node k of the step before are bounds[k] .. bounds[k + 1] - 1."""

    def __init__(self, noise: np.ndarray, bounds: np.ndarray):
        self.noise, self.bounds = noise, bounds
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.inside = noise / np.add.reduceat(noise, bounds[:-1])[self.owner]
        self.many = np.diff(bounds) > 1

    def __len__(self) -> int:
        return len(self.noise)

    def above(self) -> np.ndarray:
        return np.add.reduceat(self.noise, self.bounds[:-1])


class Units:
    """Units, those of a class side by side (class k has bounds[k] .. bounds[k + 1] - 1), and the steps that lead to them."""

    def __init__(self, weights: np.ndarray, bounds: np.ndarray):
        noise = (weights + SMOOTH) / (weights + SMOOTH).sum()
        sizes = np.diff(bounds)
        shelves = -(-sizes // SHELF)  # of each class
        first = np.cumsum(shelves) - shelves
        nth = np.arange(shelves.sum()) - np.repeat(first, shelves)
        edges = np.append(np.repeat(bounds[:-1], shelves) + nth * np.repeat(sizes, shelves) // np.repeat(shelves, shelves), bounds[-1])
        self.units = Level(noise, edges)
        self.shelves = Level(self.units.above(), np.append(first, shelves.sum()))
        n = len(sizes)
        self.classes = Level(self.shelves.above(), np.linspace(0, n, -(-n // SECTION) + 1).astype(np.int64))
        self.sections = Level(self.classes.above(), np.array([0, len(self.classes.bounds) - 1]))

    def __len__(self) -> int:
        return len(self.units)


class Vocabulary:
    """The most frequent words with counts and units, and the weight of each leaf."""

    def __init__(self, words: list[str], counts: list[int], ends: int, total: int, distinct: int, masses: np.ndarray):
        raw = [w.encode() for w in words]
        hashes = np.array([bytetext.hash_of(w) for w in raw], np.uint64)
        # Words of like endings are neighbours in a group.
        order = list(range(min(ALONE, len(words)))) + sorted(range(ALONE, len(words)), key=lambda i: raw[i][::-1])
        units = np.empty(len(words), np.int64)
        units[order] = np.arange(1, len(words) + 1)
        by = np.argsort(hashes)
        self.hashes, self.counts, self.units = hashes[by], np.array(counts, np.int64)[by], units[by]
        self.guide = _guide(self.hashes, np.arange(1 << 17, dtype=np.uint64) << np.uint64(47))
        self.ends, self.total, self.distinct = ends, total, distinct
        self.masses = masses  # sum of count + SMOOTH over the words of a leaf, and one unseen word
        self.width = len(masses) // OTHERS
        self.rest = 1 + len(words)  # unit of the first leaf
        alone = min(ALONE, len(words))
        groups = np.linspace(1 + alone, self.rest, min(GROUPS, len(words) - alone) + 1).astype(np.int64)
        bounds = np.concatenate([np.arange(1 + alone), groups, self.rest + self.width * np.arange(1, OTHERS + 1)])
        self.noise = Units(np.concatenate([[ends], np.array(counts, float)[order], masses]), bounds)

    @property
    def floor(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)


class Tokens:
    """Units of the tokens of some texts, the end of text included."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        self.data = bytetext.LOWER[data]
        self.starts, self.ends, self.bounds = bytetext.words(self.data, offsets)
        hashes = bytetext.word_hashes(self.data, self.starts, self.ends)
        if len(vocabulary.hashes):
            self.at = _seek(vocabulary.hashes, vocabulary.guide, (hashes >> np.uint64(47)).astype(np.int64), hashes)
            self.known = vocabulary.hashes.take(self.at) == hashes
        else:
            self.at, self.known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        word_unit = np.empty(len(hashes), np.int64)
        word_unit[self.known] = vocabulary.units[self.at[self.known]]
        rare = np.flatnonzero(~self.known)
        self.leaves = _leaf(self.data, self.starts[rare], self.ends[rare], hashes[rare], vocabulary.width)  # of the rare tokens
        word_unit[rare] = vocabulary.rest + self.leaves
        docs = len(offsets) - 1
        self.doc = np.repeat(np.arange(docs), np.diff(self.bounds))
        self.units = np.zeros(len(hashes) + docs, np.int64)
        self.units[np.arange(len(hashes)) + self.doc] = word_unit
        self.first = self.bounds[:-1] + np.arange(docs)  # token number of each text's first token
        self.one = np.zeros(len(self.units), np.int64)
        self.two = np.zeros(len(self.units), np.int64)
        self.one[1:] = self.units[:-1]
        self.two[2:] = self.units[:-2]
        self.one[self.first] = self.two[self.first] = 0
        second = self.first + 1
        self.two[second[second < len(self.two)]] = 0


def _rows(values: np.ndarray) -> np.ndarray:
    """Each row of a contiguous array as one element, so that rows are written whole."""
    return values.view(f"V{values.strides[0]}").ravel()


class Table:
    """Vectors that Adagrad moves."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors)
        self.power = np.full_like(self.vectors, 1e-3)

    def move(self, at: np.ndarray, gradient: np.ndarray, b: int) -> None:
        gradient = (gradient * (1 / np.sqrt(b))).astype(np.float32)
        grown = self.power.take(at, axis=0)
        grown += gradient * gradient
        _rows(self.power)[at] = _rows(grown)
        np.sqrt(grown, out=grown)
        gradient *= np.float32(RATE)
        gradient /= grown
        gradient += self.vectors.take(at, axis=0)
        _rows(self.vectors)[at] = _rows(gradient)


class Choices(Table):
    """Targets with their biases (last column) of the nodes of a level."""

    def __init__(self, level: Level, vectors: np.ndarray, noise: int):
        super().__init__(vectors)
        self.level = level
        self.mass = (noise * level.inside).astype(np.float32)
        self.shift, self.sizes = np.log(self.mass), np.diff(level.bounds)
        self.moved = np.zeros(len(level))  # how often a node was a token's own or its noise

    def learn(self, parent: np.ndarray, node: np.ndarray, hidden: np.ndarray, back: np.ndarray) -> None:
        """One batch, ordered by parent: all choices below a parent are noise to its tokens, each weighed by its frequency.

        `hidden` has a last column of ones; the gradient of it is added to `back`."""
        level = self.level
        edges = np.searchsorted(parent, np.arange(len(level.many) + 1))
        met = np.flatnonzero(level.many & (np.diff(edges) > 0))
        sizes = self.sizes[met]
        ends = np.cumsum(sizes)
        nodes = bytetext.ranges(level.bounds[met], sizes)
        t, mass = self.vectors.take(nodes, axis=0), self.mass.take(nodes)
        t[:, -1] -= self.shift.take(nodes)
        own = (np.arange(len(node)) - edges.take(parent)) * self.sizes.take(parent) + node - level.bounds.take(parent)
        gradient = np.empty_like(t)
        times = np.repeat(np.diff(edges)[met], sizes) * mass
        for k, high, size in zip(met.tolist(), ends.tolist(), sizes.tolist(), strict=True):
            at, here = slice(edges[k], edges[k + 1]), slice(high - size, high)
            h, below, cell = hidden[at], t[here], own[at]
            odds = h @ below.T
            np.exp(odds, out=odds)
            odds /= odds + 1
            true = 1 - odds.ravel()[cell]
            odds *= -mass[here]
            odds.ravel()[cell] += true
            np.matmul(odds.T, h, out=gradient[here])
            back[at] += odds @ below
        self.move(nodes, gradient, len(node))
        self.moved[nodes] += times
        self.moved += np.bincount(node, minlength=len(level))


class Model:
    """Rows of a unit (context, target, bias), then rows of a shelf, of a class and of a section (target, bias), then positions."""

    def __init__(self, units: Units, size: int = SIZE):
        rng = np.random.default_rng(7)
        self.units, self.size = units, size
        self.unit = np.zeros((len(units), 2 * size + 1), np.float32)
        self.unit[:, :size] = rng.normal(0, 0.1, (len(units), size))
        self.unit[:, -1] = np.log(units.units.inside)
        self.shelf, self.kind, self.section = (
            np.zeros((len(level), size + 1), np.float32) for level in (units.shelves, units.classes, units.sections))
        for rows, level in ((self.kind, units.classes), (self.section, units.sections)):
            rows[:, :size] = rng.normal(0, 0.1, (len(level), size))
        for rows, level in ((self.shelf, units.shelves), (self.kind, units.classes), (self.section, units.sections)):
            rows[:, -1] = np.log(level.inside)
        self.position = np.array([[1.0] * size, [0.5] * size], np.float32)

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.unit, self.shelf, self.kind, self.section, self.position)])

    def load(self, flat: np.ndarray) -> Model:
        shapes = [x.shape for x in (self.unit, self.shelf, self.kind, self.section, self.position)]
        parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        self.unit, self.shelf, self.kind, self.section, self.position = (
            np.array(p, np.float32).reshape(s) for p, s in zip(parts, shapes, strict=True))
        return self

    def steps(self) -> list[tuple[Level, np.ndarray, np.ndarray]]:
        """(level, vectors, biases) of the steps, the first one first."""
        u, size = self.units, self.size
        return [
            (u.sections, self.section[:, :-1], self.section[:, -1]), (u.classes, self.kind[:, :-1], self.kind[:, -1]),
            (u.shelves, self.shelf[:, :-1], self.shelf[:, -1]), (u.units, self.unit[:, size:-1], self.unit[:, -1])]

    def train(self, chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """One pass of noise-contrastive estimation with Adagrad; returns the tokens seen, and how often each unit's context
        vector, each unit's target vector and each shelf were moved. Batches grow with what was seen, within a chunk."""
        u, size = self.units, self.size
        context = Table(self.unit[:, :size])
        as_context = np.zeros(len(u), np.int64)
        sections, classes, shelves, targets = (
            Choices(level, rows, noise) for level, rows, noise in (
                (u.sections, self.section, NOISE), (u.classes, self.kind, NOISE), (u.shelves, self.shelf, INNER),
                (u.units, self.unit[:, size:], INNER)))
        position, power = self.position, np.full_like(self.position, 1e-3)
        seen = 0
        for word, one, two in _batches(chunks):
            b = len(word)
            seen += b
            shelf = u.units.owner.take(word)
            by = np.argsort(shelf.astype(np.uint16 if len(u.shelves) < 1 << 16 else np.int64), kind="stable")
            word, one, two, shelf = word.take(by), one.take(by), two.take(by), shelf.take(by)
            kind = u.shelves.owner.take(shelf)  # with the shelves, classes and sections are in order
            section = u.classes.owner.take(kind)
            r1, r2 = context.vectors.take(one, axis=0), context.vectors.take(two, axis=0)
            hidden = np.ones((b, size + 1), np.float32)
            np.multiply(r1, position[0], out=hidden[:, :-1])
            hidden[:, :-1] += r2 * position[1]
            back = np.zeros_like(hidden)
            for table, parent, node in (
                    (sections, np.zeros_like(section), section), (classes, section, kind), (shelves, kind, shelf), (targets, shelf, word)):
                table.learn(parent, node, hidden, back)
            columns = np.ascontiguousarray(back.T[:-1])
            times = np.bincount(one, minlength=len(u)) + np.bincount(two, minlength=len(u))
            met = np.flatnonzero(times)
            as_context += times
            place = np.zeros(len(u), np.int64)
            place[met] = np.arange(len(met))
            gradient = np.empty((size, len(met)))
            first, second = place.take(one), place.take(two)
            for s in range(size):
                gradient[s] = np.bincount(first, weights=columns[s] * position[0, s], minlength=len(met))
                gradient[s] += np.bincount(second, weights=columns[s] * position[1, s], minlength=len(met))
            context.move(met, np.ascontiguousarray(gradient.T), b)
            gradient = np.stack([np.einsum("ms,ms->s", back[:, :-1], r) for r in (r1, r2)]) / np.float32(np.sqrt(b))
            power += gradient * gradient
            position += RATE * gradient / np.sqrt(power)
        self.unit[:, :size], self.unit[:, size:] = context.vectors, targets.vectors
        self.section, self.kind, self.shelf = sections.vectors, classes.vectors, shelves.vectors
        return seen, as_context, targets.moved, shelves.moved


def _batches(chunks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    seen = 0
    for columns in chunks:
        at, n = 0, len(columns[0])
        while at < n:
            last = min(n, at + max(BATCH, (seen + at) // GROW))
            yield tuple(x[at:last] for x in columns)
            at = last
        seen += n


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Row-wise log of the sum of exponentials; the argument is overwritten."""
    top = logits.max(axis=1)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    return top + np.log(logits.sum(axis=1))


class Scorer:
    """Normalised log-probabilities of units."""

    SAFE = 80  # no product and bias beyond this: exponentials are summed as they are

    def __init__(self, model: Model):
        self.units, self.n = model.units, len(model.units)
        self.context, self.position = np.ascontiguousarray(model.unit[:, : model.size]), model.position
        self.steps = []
        for level, vectors, bias in model.steps():
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
            room = self.SAFE - float(np.abs(bias).max())
            self.steps.append((level, np.ascontiguousarray(vectors), np.ascontiguousarray(bias), np.exp(bias), room / max(longest, 1e-9)))

    def __call__(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        u = self.units
        shelf = u.units.owner.take(word)
        by = np.argsort(shelf.astype(np.uint16 if len(u.shelves) < 1 << 16 else np.int64), kind="stable")
        shelf, word = shelf.take(by), word.take(by)  # with the shelves, classes and sections are in order
        kind = u.shelves.owner.take(shelf)
        section = u.classes.owner.take(kind)
        hidden = self.context.take(one.take(by), axis=0)
        hidden *= self.position[0]
        second = self.context.take(two.take(by), axis=0)
        second *= self.position[1]
        hidden += second
        longest = float(np.sqrt(np.einsum("ij,ij->i", hidden, hidden).max(initial=0)))
        out = np.zeros(len(word), np.float32)
        parents, nodes = (np.zeros_like(section), section, kind, shelf), (section, kind, shelf, word)
        for parent, node, (level, vectors, bias, weight, reach) in zip(parents, nodes, self.steps, strict=True):
            safe = longest < reach
            edges = np.searchsorted(parent, np.arange(len(level.many) + 1))
            for k in np.flatnonzero(level.many & (np.diff(edges) > 0)).tolist():
                first, last = level.bounds[k], level.bounds[k + 1]
                own, own_bias, own_weight = vectors[first:last].T, bias[first:last], weight[first:last]
                for at in range(edges[k], edges[k + 1], 2048):
                    some = slice(at, min(at + 2048, edges[k + 1]))
                    logits = hidden[some] @ own
                    picked = node[some] - first
                    out[some] += logits[np.arange(len(picked)), picked] + own_bias.take(picked)
                    if safe:
                        np.exp(logits, out=logits)
                        out[some] -= np.log(logits @ own_weight)
                    else:
                        out[some] -= _log_sum(logits + own_bias)
        back = np.empty_like(out)
        back[by] = out
        return back


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for _, _, data, offsets in bytetext.chunks(batch.column("text"), SCORED):
            lower = bytetext.LOWER[data]
            starts, ends, _ = bytetext.words(lower, offsets)
            found = pc.value_counts(bytetext.slices(lower, starts, ends))
            parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        parts.append(pa.table({"word": pa.array([END], pa.large_string()), "n": pa.array([batch.num_rows])}))
        total = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        yield from pa.table({"word": total["word"].cast(pa.string()), "n": total["n_sum"]}).combine_chunks().to_batches()


def _train_task(vocabulary, start):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(vocabulary.value.noise).load(start.value.copy())

        def parts():
            for batch in batches:
                for _, _, data, offsets in bytetext.chunks(batch.column("text")):
                    t = Tokens(vocabulary.value, data, offsets)
                    order = np.random.default_rng(5).permutation(len(t.units))
                    yield t.units.take(order), t.one.take(order), t.two.take(order)

        seen, as_context, as_target, as_shelf = model.train(parts())
        if seen:
            # A row of a unit has two weights, its context vector's and its target's, a row of a shelf one; the rest the tokens seen.
            moved = np.stack([as_context, as_target], axis=1).astype(np.float32)
            place = 0
            for rows, weights in ((model.unit, moved), (model.shelf, as_shelf.astype(np.float32))):
                for at in range(0, len(rows), BLOCK):
                    yield _block(place + at * rows.shape[1], rows[at : at + BLOCK], weights[at : at + BLOCK])
                place += rows.size
            yield _block(place, model.parameters()[place:], np.array([seen], np.float32))

    return task


def _block(at: int, value: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"at": pa.array([at], pa.int64()), "v": pa.array([value.tobytes()], pa.binary()), "w": pa.array([weight.tobytes()], pa.binary())})


def _average(start, units: int, shelves: int):
    """`units`, `shelves`: where the rows of units and of shelves end."""

    def average(table: pa.Table) -> pa.Table:
        """The tasks' values of one block; what no task moved keeps its start."""
        at = table["at"][0].as_py()
        total = mass = None
        for v, w in zip(table["v"], table["w"], strict=True):
            weight = np.frombuffer(w.as_py(), np.float32).astype(np.float64)
            value = np.frombuffer(v.as_py(), np.float32).astype(np.float64)
            if at < units:
                weight = np.repeat(weight.reshape(-1, 2), [SIZE, SIZE + 1], axis=1).ravel()
            elif at < shelves:
                weight = np.repeat(weight, SIZE + 1)
            total = value * weight if total is None else total + value * weight
            mass = weight if mass is None else mass + weight
        made = np.where(mass > 0, total / np.maximum(mass, 1e-9), start.value[at : at + len(total)]).astype(np.float32)
        return pa.table({"at": pa.array([at], pa.int64()), "v": pa.array([made.tobytes()], pa.binary())})

    return average


_scorers: dict[int, Scorer] = {}


def _score(vocabulary, parameters, number: int):
    kind = pa.struct([
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])

    @F.arrow_udf(
        "struct<n_tokens: bigint, n_known: bigint, base: double, model: double, rare: array<struct<word: string, n: bigint>>>")
    def score(texts: pa.Array) -> pa.Array:
        v = vocabulary.value
        if number not in _scorers:
            _scorers.clear()
            _scorers[number] = Scorer(Model(v.noise).load(parameters.value))
        scorer = _scorers[number]
        out = []
        for first, last, data, offsets in bytetext.chunks(texts, SCORED):
            t = Tokens(v, data, offsets)
            docs = last - first
            log_p = scorer(t.units, t.one, t.two).astype(np.float64) / LN10
            model = np.add.reduceat(log_p, t.first)
            counts = v.counts[t.at[t.known]]
            base = np.bincount(t.doc[t.known], weights=np.log10((counts + SMOOTH) / v.floor), minlength=docs).astype(np.float64)
            base += np.log10((v.ends + SMOOTH) / v.floor)
            model -= np.bincount(t.doc[~t.known], weights=np.log10(v.masses[t.leaves]), minlength=docs)
            tokens = np.diff(t.bounds) + 1
            known = np.bincount(t.doc[t.known], minlength=docs) + (v.ends > 0)
            rare = np.flatnonzero(~t.known)
            coded = bytetext.slices(t.data, t.starts[rare], t.ends[rare]).cast(pa.string()).dictionary_encode()
            pair, n = np.unique(
                t.doc[rare] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            owner = pair // max(1, len(coded.dictionary))
            words = coded.dictionary.take(pa.array(pair - owner * max(1, len(coded.dictionary))))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, pa.array(n)], ["word", "n"]))
            out.append(pa.StructArray.from_arrays(
                [pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), lists],
                ["n_tokens", "n_known", "base", "model", "rare"]))
        return pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind)

    return score


class Trained:
    """Vocabulary, parameters and the table of all counts (word, n)."""

    def __init__(self, vocabulary: Vocabulary, parameters: np.ndarray, counts: DataFrame):
        self.vocabulary, self.parameters, self.counts = vocabulary, parameters, counts


def frequent_words(words: DataFrame) -> DataFrame:
    """The words of the highest counts, HEAD at most: whole counts only, so that no task sends its own HEAD rows to be ranked."""
    classes = words.groupBy("n").agg(F.count("*").alias("_same")).orderBy(F.desc("n")).limit(HEAD).collect()
    taken, least = 0, None
    for row in classes:
        taken += row["_same"]
        if taken > HEAD:
            break
        least = row["n"]
    return words.filter(F.lit(False)) if least is None else words.filter(F.col("n") >= least)


def train(docs: DataFrame, *, text: str = "text", rounds: int = 1) -> Trained:
    """Learn from every row of `docs`. Null text: an end only. Empty table: all words are unseen."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialise(texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    words = counts.filter(F.col("word") != END)
    head = sorted(frequent_words(words).collect(), key=lambda r: (-r["n"], r["word"]))
    ends = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    totals = counts.filter("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    rest = words.filter(F.col("n") < head[-1]["n"]) if head else words
    width = OTHERS * PER_LEAF
    width = min(LEAVES, 1 << max(2, (max(0, int(totals["v"]) - len(head)) // width).bit_length()))
    masses = np.full(OTHERS * width, SMOOTH)  # one unseen word each
    for row in rest.select(leaf_of(width)("word").alias("k"), "n").groupBy("k").agg(F.sum(F.col("n") + SMOOTH).alias("m")).collect():
        masses[row["k"]] += row["m"]
    vocabulary = Vocabulary(
        [r["word"] for r in head], [r["n"] for r in head], int(ends), int(totals["n"] or 0), int(totals["v"]), masses)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    fresh = Model(vocabulary.noise)
    parameters, ends = fresh.parameters(), (fresh.unit.size, fresh.unit.size + fresh.shelf.size)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(parameters)
        # As many tasks as cores: each sees enough text for the average to be of trained models.
        parts = texts.coalesce(max(1, spark.sparkContext.defaultParallelism))
        sums = parts.mapInArrow(_train_task(shared_vocabulary, start), "at bigint, v binary, w binary")
        parameters = parameters.copy()
        for row in sums.groupBy("at").applyInArrow(_average(start, *ends), "at bigint, v binary").collect():  # the parameters, once
            part = np.frombuffer(row["v"], np.float32)
            parameters[row["at"] : row["at"] + len(part)] = part
    return Trained(vocabulary, parameters, counts)


def score(docs: DataFrame, trained: Trained, *, text: str = "text") -> DataFrame:
    """Every row of `docs`, its text left out, with n_tokens, n_known, base_score and score (sums of log10 probabilities).

    Words: A-Z lower-cased, then runs of characters other than space and \\x09-\\x0D; one end per text. Null text: empty. Repeated
    rows are scored each. Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    v = trained.vocabulary
    udf = _score(spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(trained.parameters), hash(trained.parameters.tobytes()))
    narrow = [c for c in docs.columns if c != text]
    given = pack(docs)
    scored = materialise(
        given.select(
            F.struct(*[packed(c).alias(c) for c in narrow]).alias("_doc"), udf(F.coalesce(packed(text), F.lit(""))).alias("_s"),
            F.monotonically_increasing_id().alias("_row")),
        "scored")
    rare = scored.select("_row", F.explode("_s.rare").alias("r")).select("_row", F.col("r.word").alias("_w"), F.col("r.n").alias("_n"))
    joined = rare.join(trained.counts, F.col("_w") == F.col("word"), "left").withColumn("_c", F.coalesce("n", F.lit(0)))
    terms = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("_c") > 0, F.col("_n")).otherwise(0)).alias("_known"),
        F.sum(F.col("_n") * F.log10((F.col("_c") + SMOOTH) / v.floor)).alias("_base"),
        F.sum(F.col("_n") * F.log10(F.col("_c") + SMOOTH)).alias("_model"))  # the leaf's weight is in _s.model
    zero = F.lit(0.0)
    return unpack(
        scored.join(terms, "_row", "left"), narrow, n_tokens=F.col("_s.n_tokens"),
        n_known=F.col("_s.n_known") + F.coalesce("_known", F.lit(0)), base_score=F.col("_s.base") + F.coalesce("_base", zero),
        score=F.col("_s.model") + F.coalesce("_model", zero))


def held_out(key: Column, parts: int = 10) -> Column:
    """crc32 of the id as text, modulo `parts`, is 0; a null id is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == 0
