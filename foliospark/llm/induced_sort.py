"""External suffix sorting by induced sorting with disk-backed priority queues.

The suffixes of a text are of type S (smaller than the next one) or L (larger). The S suffixes behind an L one, LMS
for short, cut the text into substrings; these are sorted and named, the text of the names is sorted
by recursion, and its order induces the order of all suffixes: the L suffixes out of the LMS ones in ascending, the S
suffixes out of the L ones in descending order.

Induction runs over a monotone priority queue of tuples (first symbol, position): a suffix that leaves the
queue puts the suffix one position earlier into it, if that has the wanted type. Equal symbols leave in the order in
which they came, which is the order of the suffixes behind them. The queue is cut into ranges of symbols; beyond a
budget of memory its ranges are appended to files and read back, one range at a time, when their turn comes. Tuples leave
in batches: as many as precede all that they themselves will put in, so arrays are handled, not single tuples.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

RANGES = 256
#: Tuples that make a range worth its own list.
PER_RANGE = 2048
#: Longer chains within a range are followed step by step.
MAX_CHAIN = 8
BUDGET = 48 << 20


def key_kind(n_keys: int) -> type:
    """The smallest type that holds the keys and a larger value for 'none'."""
    return np.int16 if n_keys < np.iinfo(np.int16).max else np.int32


class RangeQueue:
    """A monotone queue of (key, position), FIFO among equal keys; ranges of keys go to disk beyond a budget."""

    def __init__(self, n_keys: int, folder: str, budget: int = BUDGET, size: int = RANGES * PER_RANGE):
        self.shift = 0
        while (n_keys >> self.shift) > max(8, min(RANGES, size // PER_RANGE)):
            self.shift += 1
        self.ranges = (n_keys >> self.shift) + 1
        self.kind = key_kind(n_keys)
        self.memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.ranges)]
        self.on_disk: dict[int, str] = {}
        self.folder, self.budget, self.held = folder, budget, 0

    def push(self, keys: np.ndarray, at: np.ndarray) -> None:
        if not len(keys):
            return
        r = (keys >> self.shift).astype(np.uint16) if self.shift or keys.dtype != np.int16 else keys
        if r[0] == r[-1] and (r == r[0]).all():
            self.memory[int(r[0])].append((keys, at))
        else:
            order = np.argsort(r, kind="stable")
            r, keys, at = r[order], keys[order], at[order]
            cut = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for s, e in zip(cut, cut[1:]):
                self.memory[int(r[s])].append((keys[s:e], at[s:e]))
        self.held += 8 * len(keys)
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        for r, held in enumerate(self.memory):
            if held:
                path = self.on_disk.setdefault(r, os.path.join(self.folder, f"range-{id(self)}-{r}"))
                with open(path, "ab") as f:
                    for keys, at in held:
                        np.stack([keys.astype(np.int32), at], 1).tofile(f)
                self.memory[r] = []
        self.held = 0

    def pop(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """All that range r holds, in the order in which it came."""
        keys, at = [], []
        if r in self.on_disk:
            path = self.on_disk.pop(r)
            rows = np.fromfile(path, np.int32).reshape(-1, 2)
            os.remove(path)
            keys.append(rows[:, 0].astype(self.kind))
            at.append(rows[:, 1])
        for k, a in self.memory[r]:
            keys.append(k)
            at.append(a)
            self.held -= 8 * len(k)
        self.memory[r] = []
        if not keys:
            return np.empty(0, self.kind), np.empty(0, np.int32)
        return (keys[0], at[0]) if len(keys) == 1 else (np.concatenate(keys), np.concatenate(at))


def _whole_range(keys: np.ndarray, at: np.ndarray, put: np.ndarray, never: int, r: int, shift: int):
    """All of a range at once: (keys, positions) in order, and what goes to later ranges; None if chains within the range are long.

    Members that came from outside are ordered by symbol and arrival; those that members of the range put in come after
    them within their symbol, in the order of their sources, which settles in as many steps as such chains are long.
    """
    own = len(at)
    members_key, members, sources = [keys], [at], []
    begin, targets = 0, []
    for _ in range(MAX_CHAIN + 1):
        target = put[members[-1] - 1]
        targets.append(target)
        here = np.flatnonzero((target != never) & ((target >> shift) == r))
        if not len(here):
            break
        sources.append(begin + here)
        begin += len(members[-1])
        members_key.append(target[here])
        members.append(members[-1][here] - 1)
    else:
        return None
    if sources:
        keys, at, target = np.concatenate(members_key), np.concatenate(members), np.concatenate(targets)
        source = np.concatenate(sources)
        second = np.arange(len(at), dtype=np.int64)
        high = keys.astype(np.int64) << 32
        order = np.argsort(high | second)
        while True:
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at))
            second[own:] = own + rank[source]
            now = np.argsort(high | second)
            if (now == order).all():
                break
            order = now
    else:
        target = targets[0]
        order = np.argsort(keys, kind="stable")
    keys, at, target = keys[order], at[order], target[order]
    out = (target != never) & ((target >> shift) != r)
    return keys, at, target[out], at[out] - 1


def _induce(text: np.ndarray, n_keys: int, seeds: np.ndarray, wanted: np.ndarray, first: int | None, emit_seeds: bool, folder: str, budget: int) -> np.ndarray:
    """Positions in the order in which they leave the queue; seeds are sorted sources that come after the others of their symbol."""
    queue = RangeQueue(2 * n_keys, folder, budget, len(text))
    kind = queue.kind
    never = np.iinfo(kind).max
    if first is not None:
        queue.push(np.array([2 * int(text[first])], kind), np.array([first], np.int32))
    # what the suffix at p puts into the queue has the key put[p - 1]; nothing stands before position 0
    put = np.full(len(text) + 1, never, kind)
    np.copyto(put[:-1], text.astype(kind) * kind(2), where=wanted)
    seed_keys = text[seeds].astype(kind) * kind(2) + kind(1)
    seed_range = seed_keys >> queue.shift
    bounds = np.searchsorted(seed_range, np.arange(queue.ranges + 1))
    out: list[np.ndarray] = []
    for r in range(queue.ranges):
        keys, at = queue.pop(r)
        mine = seeds[bounds[r] : bounds[r + 1]]
        if len(mine):
            keys = np.concatenate([keys, seed_keys[bounds[r] : bounds[r + 1]]])
            at = np.concatenate([at, mine])
        if queue.shift > 1 and len(at):
            whole = _whole_range(keys, at, put, never, r, queue.shift)
            if whole is not None:
                keys, at, new_keys, new = whole
                out.append(at if emit_seeds else at[(keys & 1) == 0])
                queue.push(new_keys, new)
                continue
        if len(keys) > 1:
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
        while len(at):
            before = at - 1
            target = put[before]
            m = len(at)
            if m > 1 and keys[-1] > target.min():
                late = keys[1:] > np.minimum.accumulate(target)[:-1]
                k = int(late.argmax())
                if late[k]:
                    m = k + 1
            out.append(at[:m] if emit_seeds else at[:m][(keys[:m] & 1) == 0])
            ok = target[:m] != never
            new_keys, new = target[:m][ok], before[:m][ok]
            here = (new_keys >> queue.shift) == r
            keys, at = keys[m:], at[m:]
            if here.any():
                queue.push(new_keys[~here], new[~here])
                new_keys, new = new_keys[here], new[here]
                if len(keys):
                    keys, at = np.concatenate([keys, new_keys]), np.concatenate([at, new])
                    order = np.argsort(keys, kind="stable")
                    keys, at = keys[order], at[order]
                elif len(new) > 1 and (new_keys[1:] < new_keys[:-1]).any():
                    order = np.argsort(new_keys, kind="stable")
                    keys, at = new_keys[order], new[order]
                else:
                    keys, at = new_keys, new
            else:
                queue.push(new_keys, new)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S. The end of the text is smaller than any symbol."""
    n = len(text)
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    decided = np.full(n, n - 1, np.int64)
    differs = np.flatnonzero(text[:-1] != text[1:])
    decided[differs] = differs
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return rises[decided]


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _names(text: np.ndarray, n_keys: int, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each LMS substring, in text order, its rank among the distinct ones.

    A substring reaches to the next LMS position, with it. Symbols are packed into words, as many as fit, and words sorted. Where a
    substring ends, another with the same symbols goes on with an L suffix, and so is smaller: an end counts
    more than any symbol. Only the end of the text counts less.
    """
    bits = int(n_keys + 1).bit_length()
    per_word = 63 // bits
    length = np.append(np.diff(lms) + 1, len(text) + 1 - lms[-1]).astype(np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, [0]])

    def word(which: np.ndarray, block: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for j in range(block * per_word, (block + 1) * per_word):
            inside = j < length[which]
            symbol = padded[np.where(inside, lms[which].astype(np.int64) + j, -1)]
            out = (out << bits) | np.where(inside, symbol, n_keys + 1)
        return out

    everything = np.arange(len(lms))
    rank = _dense(word(everything, 0))
    long = np.flatnonzero(length >= per_word)  # their end is in none of the symbols so far
    if len(long):
        blocks = int(length[long].max()) // per_word
        columns = [word(long, k) for k in range(1, blocks + 1)]
        order = np.lexsort([*columns[::-1], rank[long]])
        new = np.zeros(len(long), bool)
        for c in (rank[long], *columns):
            new[1:] |= c[order][1:] != c[order][:-1]
        among = np.empty(len(long), np.int64)
        among[order] = np.cumsum(new) + 1
        rank = rank << 32
        rank[long] |= among
        rank = _dense(rank)
    return rank.astype(np.int32), int(rank.max()) + 1


def _sorted(text: np.ndarray, n_keys: int, folder: str, budget: int) -> np.ndarray:
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)

    def everything(seeds: np.ndarray) -> np.ndarray:
        large = _induce(text, n_keys, seeds, ~small, n - 1, False, folder, budget)
        turned = n_keys - 1 - text.astype(np.int32)
        return _induce(turned, n_keys, large[::-1], small, None, True, folder, budget)[::-1]

    if len(lms) < 2:
        return everything(lms)
    named, kinds = _names(text, n_keys, lms)
    if kinds < len(lms):
        order = lms[_sorted(named, kinds, folder, budget)]
    else:
        order = np.empty_like(lms)
        order[named] = lms
    return everything(order)


def suffix_array(text: np.ndarray, n_keys: int, budget: int = BUDGET) -> np.ndarray:
    """Suffixes of text (integers in 0 .. n_keys - 1) in order; queue files are the task's own and go at its end."""
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        return _sorted(text, n_keys, folder, budget)


def long_common(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbours order[i], order[i+1]: do depth bytes agree? All of order have depth bytes before their end."""
    same = np.ones(max(0, len(order) - 1), bool)
    words = np.ndarray((max(0, len(raw) - 7),), np.uint64, raw.tobytes() if not raw.flags.c_contiguous else raw, 0, (1,))
    left = np.arange(len(same))
    for offset in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        ok = words[order[left] + offset] == words[order[left + 1] + offset]
        same[left[~ok]] = False
        left = left[ok]
        if not len(left):
            break
    return same
