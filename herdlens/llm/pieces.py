"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

A text is cut into units, each a run of blanks with the word after it; no piece crosses a unit, so the lattice of a
text is a chain of unit lattices. The deterministic encoding is the library's own. For sampling, a piece of rank r has
weight ``-ALPHA * log(r + 2)`` (the model's own scores are ranks); summing backwards gives every lattice node its exact
log-mass. The search keeps sets of segmentations of a text in a queue, ordered by a Gumbel variable truncated by its
parent's: the best set yields its best segmentation, and the rest of it is cut into one set for each unit, those that
first differ there. So segmentations come out distinct and in order of their perturbed log-probability, exactly as if
all had been perturbed. ``inclusion`` is 1 - exp(-exp(log-probability - threshold)), the threshold being the next
perturbed value (1 if there is none). Random numbers are hashes of the row key, so a row samples the same anywhere.

A set of segmentations with a probability below 1e-12 counts as empty, as differences of doubles tell no more.

Cases: null and empty texts have no pieces and one empty segmentation with probability 1; texts with fewer than k
segmentations give all of them; equal keys with equal texts get equal samples; a null key counts as 0; characters outside the
vocabulary become byte pieces; an empty table gives an empty result. Columns of the input named like a result column
are replaced.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm import common
from herdlens.llm.shingles import mix

ALPHA, TOP = 1.0, 2
BLANK = "▁"
UNITS = re.compile(rf"{BLANK}*[^{BLANK}]+(?:{BLANK}+\Z)?|{BLANK}+\Z")
CHUNK_CHARS = 120_000


def _unit_random(key: np.ndarray, step: int) -> np.ndarray:
    """Uniform in (0, 1) from a key and a step."""
    return ((mix(key + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Lattices:
    """Lattices of the units seen, as flat tables of nodes and edges, and the library's encoding of each.

    The tables are emptied between two groups of texts once they hold so many edges (20 bytes each), or units.
    """

    MOST_UNITS, MOST_EDGES = 250_000, 3_000_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(size):
            if self.model.is_byte(i):
                self.byte_id[int(self.pieces[i][3:-1], 16)] = i
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-self.model.get_score(i), i)))}
        self.byte_score = -ALPHA * np.log(size + 2)
        self.steps = self._trie({self.pieces[i]: i for i in plain})
        self.score = np.array([-ALPHA * np.log(rank[i] + 2) if i in rank else 0.0 for i in range(size)])
        # What a piece decodes to.
        texts = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.text_size = np.array([len(t) for t in texts])
        self.text_begin = np.concatenate([[0], np.cumsum(self.text_size)])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        kinds = {
            "root": np.int32, "own_begin": np.int32, "own_size": np.int32, "own": np.int32, "edge_begin": np.int32,
            "cum": np.float32, "log": np.float64, "next": np.int32, "piece": np.int32, "lone": np.int32,
        }
        self.tab = {k: np.zeros(0, kind) for k, kind in kinds.items()}
        self.clear()

    def _trie(self, ids: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each length the prefixes of pieces: (place of the prefix one shorter, last character), sorted, and the piece's id or -1."""
        chars = sorted(set(chain.from_iterable(ids)))
        self.kind = np.zeros(0x110000, np.int32)  # characters of pieces by number, from 1
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        prefixes: list[set[str]] = [set() for _ in range(max(map(len, ids)))]
        for piece in ids:
            for n in range(len(piece)):
                prefixes[n].add(piece[: n + 1])
        steps, place = [], {"": 0}
        for own in prefixes:
            coded = sorted((place[x[:-1]] * self.kinds + int(self.kind[ord(x[-1])]), x) for x in own)
            place = {x: i for i, (_, x) in enumerate(coded)}
            steps.append((np.array([c for c, _ in coded], np.int32 if coded[-1][0] < 1 << 31 else np.int64), np.array([ids.get(x, -1) for _, x in coded], np.int64)))
        return steps

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.used = dict.fromkeys(self.tab, 0)
        self.nodes = self.edges = self.own_count = self.lone_count = 0

    def learn(self, units: list[str]) -> None:
        """Add the lattices of units not seen before."""
        n = len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        joined = "".join(units)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        total = len(chars)
        first = np.cumsum(size) - size
        left = np.repeat(first + size, size) - np.arange(total)  # characters up to the unit's end
        # All pieces that begin at a character, by one step down the trie for all characters at once.
        kind = self.kind[chars]
        at, place, found = np.arange(total), np.zeros(total, np.int64), []
        for k, (codes, ids) in enumerate(self.steps, 1):
            if k > 1:
                near = left[at] >= k
                at, place = at[near], place[near]
            if not len(at):
                break
            own = place * self.kinds + kind[at + k - 1]
            own = np.where(own <= codes[-1], own, -1).astype(codes.dtype)
            place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[place] == own
            at, place = at[hit], place[hit]
            piece = ids[place]
            whole = piece >= 0
            found.append((at[whole], piece[whole], k))
        # A character that is no piece is its bytes: piece -1 is the first such character seen, -2 the next one.
        single = np.zeros(total, bool)
        for begun, _, k in found[:1]:
            single[begun] = True
        lone = np.flatnonzero(~single)
        found.insert(0, (lone, -1 - self.lone_count - np.arange(len(lone)), 1))
        count = np.zeros(total, np.int64)
        for begun, _, _ in found:
            count[begun] += 1
        begin = np.cumsum(count) - count
        # Nodes: every character and one end for each unit. Edges lie by node, the longest first.
        edges, unseen = int(count.sum()), begin + count
        piece, span, source = (np.zeros(edges, np.int64) for _ in range(3))
        for begun, ids, k in found:
            unseen[begun] -= 1
            e = unseen[begun]
            piece[e], span[e], source[e] = ids, k, begun
        source += np.repeat(np.arange(n), size)[source]
        lone_bytes = [chr(c).encode("utf-8", "replace") for c in chars[lone].tolist()]
        score = self.score[np.maximum(piece, 0)]
        if len(lone):
            bytes_at = np.flatnonzero(piece < 0)
            score[bytes_at] = np.array([len(b) * self.byte_score for b in lone_bytes])[-1 - self.lone_count - piece[bytes_at]]
        # Sums of masses from the units' ends backwards: the characters so far from the end, of all units as long.
        nodes = total + n
        mass, by_size = np.zeros(nodes), np.argsort(-size, kind="stable")
        lasting = np.searchsorted(-size[by_size], -np.arange(1, int(size.max()) + 1), side="right")
        ends = (first + size)[by_size]
        for d, many in enumerate(lasting.tolist(), 1):
            own = ends[:many] - d
            e = _gather(begin[own], count[own])
            through = score[e] + mass[source[e] + span[e]]
            group = np.cumsum(count[own]) - count[own]
            top = np.maximum.reduceat(through, group)
            mass[own + by_size[:many]] = top + np.log(np.add.reduceat(np.exp(through - np.repeat(top, count[own])), group))
        log = np.minimum(0.0, score + mass[source + span] - mass[source])
        chance = np.exp(log)
        running = np.cumsum(chance)
        cum = running - np.repeat((running - chance)[begin], count)
        cum[begin + count - 1] = 2.0
        edge_begin = np.full(nodes, -1, np.int64)
        edge_begin[np.arange(total) + np.repeat(np.arange(n), size)] = self.edges + begin
        words = [u[1:] for u in units]
        encoded = self.model.encode(words if joined.count(BLANK) == n else [w.replace(BLANK, " ") for w in words], num_threads=1)  # a task has one core
        own_size = np.fromiter(map(len, encoded), np.int64, n)
        new = {
            "root": self.nodes + first + np.arange(n), "own_begin": self.own_count + np.cumsum(own_size) - own_size, "own_size": own_size,
            "own": np.fromiter(chain.from_iterable(encoded), np.int32, int(own_size.sum())), "edge_begin": edge_begin,
            "cum": cum, "log": log, "next": self.nodes + source + span, "piece": piece, "lone": chars[lone],
        }
        for k, v in new.items():  # tables grow by a quarter at least
            have, need = self.used[k], self.used[k] + len(v)
            if need > len(self.tab[k]):
                self.tab[k] = np.concatenate([self.tab[k][:have], np.zeros(need + need // 4 - have, self.tab[k].dtype)])
            self.tab[k][have:need] = v
            self.used[k] = need
        self.number.update(zip(units, range(len(self.number), len(self.number) + n), strict=True))
        self.nodes, self.edges = self.nodes + nodes, self.edges + edges
        self.lone_count, self.own_count = self.lone_count + len(lone), self.own_count + int(own_size.sum())

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Unit numbers of each text."""
        cut = []
        for t in texts:
            # Where every blank stands alone between two words, units begin at the blanks.
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or BLANK in t:
                cut.append(UNITS.findall(BLANK + t.replace(" ", BLANK)))
            else:
                cut.append((BLANK + t.replace(" ", " " + BLANK)).split(" "))
        if len(self.number) > self.MOST_UNITS or self.edges > self.MOST_EDGES:
            self.clear()
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        which = np.fromiter(map(self.number.get, every, repeat(-1)), np.int64, len(every))
        fresh = np.flatnonzero(which < 0).tolist()
        if fresh:
            self.learn(sorted({every[i] for i in fresh}))
            which[fresh] = [self.number[every[i]] for i in fresh]
        return np.split(which, np.cumsum(size)[:-1]) if len(cut) else []

    def sample(self, unit: np.ndarray, key: np.ndarray):
        """One segmentation of each unit: (edges of all, edges of each, log-probability of each)."""
        t = self.tab
        at, active = t["root"][unit], np.arange(len(unit))
        steps, log, length, step = [], np.zeros(len(unit)), np.zeros(len(unit), np.int64), 0
        active = active[t["edge_begin"][at] >= 0]
        at = at[active]
        while len(active):
            draw = _unit_random(key[active], step)
            edge = t["edge_begin"][at]
            late = np.flatnonzero(draw > t["cum"][edge])
            while len(late):
                edge[late] += 1
                late = late[draw[late] > t["cum"][edge[late]]]
            steps.append((active, edge))
            log[active] += t["log"][edge]
            length[active] += 1
            at = t["next"][edge]
            more = t["edge_begin"][at] >= 0
            at, active, step = at[more], active[more], step + 1
        begin = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.int64)
        for s, (who, edge) in enumerate(steps):
            flat[begin[who] + s] = edge
        return flat, length, log

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the edges, and where those of each edge begin and the last ones end."""
        ids = self.tab["piece"][edges].astype(np.int64)
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, np.arange(len(ids) + 1)
        many = [self.byte_id[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in self.tab["lone"][-1 - ids[lone]].tolist()]
        size = np.ones(len(ids), np.int64)
        size[lone] = [len(m) for m in many]
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        out[_gather(begin[lone], size[lone])] = np.concatenate(many)
        return out, begin

    def decodes(self, ids: np.ndarray, bound: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which of the runs of ids that begin and end at ``bound`` are the UTF-8 of their text, behind the blank that each gets."""
        made = self.text_bytes[_gather(self.text_begin[ids], self.text_size[ids])]
        given = np.frombuffer(b"".join(b" " + r if r else r for r in raw), np.uint8)
        made_bound = np.concatenate([[0], np.cumsum(self.text_size[ids])])[bound]
        given_bound = np.cumsum([0, *(len(r) + bool(r) for r in raw)])
        if np.array_equal(made_bound, given_bound) and np.array_equal(made, given):
            return np.ones(len(raw), bool)
        cuts = zip(made_bound[:-1], made_bound[1:], given_bound[:-1], given_bound[1:], strict=True)
        return np.array([np.array_equal(made[a:b], given[c:d]) for a, b, c, d in cuts], bool)


class Search:
    """Gumbel top-k over the units of a group of texts, all texts together."""

    def __init__(self, lattices: Lattices, units: list[np.ndarray], keys: np.ndarray, top: int):
        self.lat, self.top, self.keys = lattices, top, keys
        self.size = np.array([len(u) for u in units], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.unit = np.concatenate(units) if units else np.zeros(0, np.int64)
        self.out: list[list[tuple]] = [[] for _ in units]
        self.queue: list[list[tuple]] = [[] for _ in units]

    def threshold(self, i: int) -> float | None:
        """The perturbed value of the first segmentation left out, if any is."""
        return -self.queue[i][0][0] if self.queue[i] else None

    def _draw(self, text: np.ndarray, place: np.ndarray, round_no: int):
        """Segmentations of the units at ``place`` of ``text``."""
        key = mix(self.keys[text] + np.uint64(round_no * 1_000_003 + 17)) + (place - self.begin[text]).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        return self.lat.sample(self.unit[place], key)

    def run(self) -> list[list[tuple]]:
        """Per text the (edges, log-probability, perturbed value) in order, and the next perturbed value behind them."""
        texts = len(self.size)
        every = np.arange(texts)
        root = -np.log(-np.log(_unit_random(mix(self.keys + np.uint64(3)), 0)))
        whole = np.repeat(every, self.size)
        flat, length, log = self._draw(whole, np.arange(len(self.unit)), 0)
        # The state of a sample: its edges, where each unit's begin, and the log-probability of each unit.
        bound = np.concatenate([[0], np.cumsum(length)])
        states = []
        for a, b in zip(self.begin.tolist(), (self.begin + self.size).tolist(), strict=True):
            states.append((flat[bound[a] : bound[b]], bound[a : b + 1] - bound[a], log[a:b]))
        self._emit(every, states, root, np.zeros(texts, np.int64), [[] for _ in range(texts)], 0)
        for r in range(1, self.top):
            self._next(r)
        return self.out

    def _emit(self, text: np.ndarray, states: list[tuple], value: np.ndarray, first: np.ndarray, taken: list[list], round_no: int) -> None:
        """Take a segmentation of each text and queue the sets left: one for each unit from ``first`` on."""
        totals = [np.concatenate([[0.0], np.cumsum(log)]) for _, _, log in states]
        for i, (edges, _, _), total, v in zip(text.tolist(), states, totals, value.tolist(), strict=True):
            self.out[i].append((edges, float(total[-1]), v))
        size = self.size[text] - first
        cut = np.concatenate([[0], np.cumsum(size)])
        if not cut[-1]:
            return
        firsts = first.tolist()
        gone = np.exp(np.concatenate([log[f:] for f, (_, _, log) in zip(firsts, states, strict=True)]))
        for at, out_logs in zip(cut.tolist(), taken):
            if out_logs:
                gone[at] += sum(np.exp(x) for _, x in out_logs)
        mass = np.concatenate([total[f:-1] for f, total in zip(firsts, totals, strict=True)]) + np.log(np.maximum(1 - gone, 1e-300))
        mass[gone > 1 - 1e-12] = -np.inf
        key = np.repeat(mix(self.keys[text] + np.uint64(round_no * 7919 + 5)), size) + _gather(first, size).astype(np.uint64)
        noise = np.log(-np.log(_unit_random(key, 1)))  # minus a standard Gumbel
        with np.errstate(over="ignore"):
            bound_value = -np.logaddexp(np.repeat(-value, size), noise - mass)
        wanted = self.top - round_no  # those still to come, and the one behind them
        for n, (i, begin, end) in enumerate(zip(text.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            own, at = bound_value[begin:end], firsts[n]
            if wanted > 4:
                best = np.argsort(-own, kind="stable")[:wanted].tolist()
            else:
                best, rest = [], own.copy()
                while begin < end and len(best) < wanted and np.isfinite(rest[j := int(rest.argmax())]):
                    best.append(j)
                    rest[j] = -np.inf
            edges, bound, log = states[n]
            for j in best:
                if np.isfinite(mass[begin + j]):
                    unit = at + j
                    out = [*(taken[n] if j == 0 else []), (edges[bound[unit] : bound[unit + 1]].tobytes(), float(log[unit]))]
                    heapq.heappush(self.queue[i], (-float(own[j]), len(self.out[i]) * 1_000_000_000 + unit, unit, out, states[n]))

    def _next(self, r: int) -> None:
        """The next segmentation of every text that has one: its prefix, another segmentation of one unit, a new rest."""
        live = [i for i in range(len(self.size)) if len(self.out[i]) == r and self.queue[i]]
        if not live:
            return
        taken = {i: heapq.heappop(self.queue[i]) for i in live}
        text = np.array(live)
        unit = np.array([taken[i][2] for i in live])
        changed = self._other(text, unit, [taken[i][3] for i in live], r)
        rest = self.size[text] - unit - 1
        place = _gather(self.begin[text] + unit + 1, rest)
        flat, length, log = self._draw(np.repeat(text, rest), place, r)
        cut = np.concatenate([[0], np.cumsum(rest)])
        ends = np.concatenate([[0], np.cumsum(length)])
        made = []
        for n, i in enumerate(live):
            value, _, at, own, (edges, bound, logs) = taken[i]
            part = changed[n]
            if part is None:
                continue
            a, b = cut[n], cut[n + 1]
            new_edges = np.concatenate([edges[: bound[at]], part[0], flat[ends[a] : ends[b]]])
            new_bound = np.concatenate([bound[: at + 1], bound[at] + len(part[0]) + ends[a : b + 1] - ends[a]])
            made.append((i, (new_edges, new_bound, np.concatenate([logs[:at], [part[1]], log[a:b]])), -value, at, own))
        if made:
            text, states, values, first, own = zip(*made, strict=True)
            self._emit(np.array(text), list(states), np.array(values), np.array(first), list(own), r)

    def _other(self, text: np.ndarray, unit: np.ndarray, taken: list[list], r: int) -> list:
        """A segmentation of one unit of each text that is none of those taken: drawn again, else among the others only."""
        found: list = [None] * len(text)
        open_ = np.arange(len(text))
        for tries in (range(1), range(1, 4), range(4, 13), range(13, 40)):  # several draws at once: the first new one counts
            if not len(open_):
                return found
            steps = np.array([r * 104729 + attempt * 31 + 11 for attempt in tries], np.uint64)
            unit_no = self.unit[self.begin[text[open_]] + unit[open_]]
            key = (mix(self.keys[text[open_], None] + steps) + unit[open_, None].astype(np.uint64)).ravel()
            flat, length, log = self.lat.sample(np.repeat(unit_no, len(tries)), key)
            ends = np.concatenate([[0], np.cumsum(length)]).tolist()
            still = []
            for n, k in enumerate(open_.tolist()):
                known = {t for t, _ in taken[k]}
                for m in range(n * len(tries), (n + 1) * len(tries)):
                    own = flat[ends[m] : ends[m + 1]]
                    if own.tobytes() not in known:
                        found[k] = (own, log[m])
                        break
                else:
                    still.append(k)
            open_ = np.array(still, np.int64)
        for k in open_.tolist():
            found[k] = self._left(int(self.unit[self.begin[text[k]] + unit[k]]), {t for t, _ in taken[k]}, self.keys[text[k]], r)
        return found

    def _left(self, unit: int, taken: set[bytes], key: np.uint64, r: int):
        """A segmentation of a unit drawn exactly from those not taken, or None if there is none.

        The taken ones form a tree of prefixes. From its leaves up, each prefix gets the probability that what follows
        it is not taken: a sum over its edges without any difference, so that the little that a dominant segmentation
        leaves is not lost. Going down, an edge is drawn by its probability times that of the prefix it leads to.
        """
        t = self.lat.tab
        nodes, children = [int(t["root"][unit])], [{}]
        for path in (np.frombuffer(x, np.int64).tolist() for x in sorted(taken)):
            at = 0
            for edge in path:
                if edge not in children[at]:
                    children[at][edge] = len(nodes)
                    nodes.append(int(t["next"][edge]))
                    children.append({})
                at = children[at][edge]

        def edges(node: int) -> list[int]:
            first = last = int(t["edge_begin"][node])
            if first < 0:
                return []
            while t["cum"][last] <= 1.5:
                last += 1
            return list(range(first, last + 1))

        free = [0.0] * len(nodes)
        for at in range(len(nodes) - 1, -1, -1):  # children come after their parents
            free[at] = sum(np.exp(t["log"][e]) * (free[children[at][e]] if e in children[at] else 1.0) for e in edges(nodes[at]))
        if not free[0] > 0:
            return None
        draw, at, node, path, log = np.random.default_rng([int(key) & 0xFFFFFFFF, r]), 0, nodes[0], [], 0.0
        while own := edges(node):
            known = children[at] if at is not None else {}
            weight = np.array([np.exp(t["log"][e]) * (free[known[e]] if e in known else 1.0) for e in own])
            rising = np.cumsum(weight)
            edge = own[min(int(np.searchsorted(rising, draw.random() * rising[-1], side="right")), int(np.flatnonzero(weight)[-1]))]
            at, node = known.get(edge), int(t["next"][edge])
            path.append(edge)
            log += float(t["log"][edge])
        return np.array(path, np.int64), log


def lattices_of(path: str) -> Lattices:
    """The lattices of this Python worker, kept with the library's module beyond one task."""
    import sentencepiece

    kept = vars(sentencepiece).setdefault("_lattices_by_path", {})
    if path not in kept:
        kept[path] = Lattices(path)
    return kept[path]


SAMPLE = T.StructType(
    [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType())]
)
FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("samples", T.ArrayType(SAMPLE)), T.StructField("exact", T.BooleanType())]


def _lists(flat: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], *sizes]).cumsum()
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32)))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with the library's ids, ``top`` sampled segmentations, and whether all of them decode to the text."""

    def compute(texts: pa.Array, keys: pa.Array) -> list[pa.Array]:
        lat, values = lattices_of(model), texts.to_pylist()
        seeds = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        own, own_size, ids, ids_size, logs, perturbed, inclusion, count, exact = ([] for _ in range(9))
        for a, b in common.chunks(np.array([len(t) for t in values], np.int64), CHUNK_CHARS):
            units = lat.units(values[a:b])
            search = Search(lat, units, seeds[a:b], top)
            found, t = search.run(), lat.tab
            raw, every = [v.encode() for v in values[a:b]], search.unit
            own.append(t["own"][_gather(t["own_begin"][every], t["own_size"][every])])
            bound = np.concatenate([[0], np.cumsum(t["own_size"][every], dtype=np.int64)])[np.append(search.begin, len(every))]
            own_size.append(np.diff(bound))
            good = lat.decodes(own[-1], bound, raw)
            rows = [len(f) for f in found]
            edges = [e for f in found for e, _, _ in f]
            sampled, begin = lat.ids(np.concatenate([np.zeros(0, np.int64), *edges]))
            bound = begin[np.cumsum([0, *map(len, edges)])]
            ids.append(sampled.astype(np.int32))
            ids_size.append(np.diff(bound))
            decoded = lat.decodes(sampled, bound, [r for r, n in zip(raw, rows, strict=True) for _ in range(n)])
            good[np.repeat(np.arange(b - a), rows)[~decoded]] = False
            for k, f in enumerate(found):
                beyond = search.threshold(k)
                for _, log, value in f:
                    logs.append(log)
                    perturbed.append(value)
                    inclusion.append(np.inf if beyond is None else log - beyond)
            count.append(rows)
            exact.append(good)
        kept = -np.expm1(-np.exp(np.minimum(50.0, np.array(inclusion, float))))  # 1 without a threshold
        numbers = [pa.array(x, pa.float64()) for x in (logs, perturbed, kept)]
        structs = pa.StructArray.from_arrays([_lists(ids, ids_size), *numbers], names=["ids", "log_prob", "perturbed", "inclusion"])
        offsets = pa.array(np.concatenate([[0], *count]).cumsum().astype(np.int32))
        good = np.concatenate([np.zeros(0, bool), *exact])
        return [_lists(own, own_size), pa.ListArray.from_arrays(offsets, structs), pa.array(good, pa.bool_())]

    return common.append(docs, FIELDS, text, compute, F.coalesce(F.xxhash64(F.col(f"`{key}`")), F.lit(0)))
