"""BPE encoding and decoding through a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges give. It starts as one state on which every byte
loops. A merge (u, v) -> w adds a gadget: what u leads to is split off into a copy without the transition on v, and w
gets a transition wherever u then v could be read, to where v led. A copy differs from its origin by one transition,
so a state is stored as (origin, transition removed, time) and a token as (left part, time). Where a token leads depends
on the token alone, hence the automaton is deterministic.

The driver compiles it once into compact arrays, which Spark broadcasts: `removals` is a hash table of every transition that a
live state lacks, with the time it was removed; a transition is read if neither the token nor a left part of it, at
the time it was joined, is listed. The vocabulary's trie is two tables of 16 columns, one for each half of a byte.

Each prefix of a word has one path, so the word is encoded forward: `last[p]` is the token that ends at byte p on the path,
the one match of the vocabulary there that is a transition from the state behind it. All distinct words of a step are
encoded together, one byte position at a time; nothing is tried twice. Decoding emits the labels of the arcs.

Words are told apart by a hash; the emitted labels are held against the bytes that came in, and where they differ (two
words of one hash) the step is repeated with another hash. So results are exact.

Defined cases: a null text counts as empty and has no tokens; the strings of added tokens in a text become those tokens,
as the library does; bytes that are no UTF-8 decode to U+FFFD; letters newer than the library's Unicode tables split words
as it splits them, where the driver has the library. Texts are whole; long ones go through in steps cut before white
space, where a word always begins. Rows are independent, so repeated rows and ties get equal results; carried columns
pass through, a carried column named like an output column is refused. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick, refuse, ship

#: The endings that the pre-splitting of byte-level BPE vocabularies takes for words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Classes of code points: white space, letters, digits, others, and what is between texts.
BLANK, LETTER, DIGIT, OTHER, BREAK = range(5)
#: So many code points are encoded at once; words of more bytes are encoded one at a time.
STEP_CHARS, LONG_WORD = 1 << 20, 64
#: A worker remembers so many words; when they are too many, those of the last step stay.
MOST_WORDS = 400_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (256 + k for k in range(256))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


def labels(vocab: dict[str, int], added: dict[str, int] | None = None) -> list[bytes]:
    """What each id's arc spells."""
    to_byte = byte_chars()
    out = [b""] * (max([*vocab.values(), *(added or {}).values()]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
    for text, i in (added or {}).items():
        out[i] = text.encode()
    return out


class Automaton:
    """Compiled from {token string: id} and merges in order of priority."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], added: dict[str, int] = {}) -> None:  # noqa: B006
        to_byte = byte_chars()
        self.label = labels(vocab, added)
        size = len(self.label)
        self.left, self.born, self.leads = [0] * size, [-1] * size, [0] * size
        self.origin, self.removed, self.split_at = [0], [-1], [0]
        for char in to_byte:
            if char in vocab:
                self.born[vocab[char]] = 0
        for time, (a, b) in enumerate(merges, 1):
            self.add_gadget(time, vocab[a], vocab[b], vocab[a + b])

    def add_gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0 or not self.allowed(self.leads[u], v):
            return  # u then v is never read: no word needs this merge
        after = self.leads[v]
        self.origin.append(self.leads[u])
        self.removed.append(v)
        self.split_at.append(time)
        self.leads[u] = len(self.origin) - 1
        self.left[w], self.born[w], self.leads[w] = u, time, after

    def allowed(self, state: int, token: int) -> bool:
        """Whether the state has a transition on the token."""
        left, born, origin, removed, split_at = self.left, self.born, self.origin, self.removed, self.split_at
        while True:
            if born[token] >= split_at[state]:  # the token came with or after the state: it is read wherever its left part is
                if not born[token]:
                    return True
                token = left[token]
            elif removed[state] == token:
                return False
            else:
                state = origin[state]

    def tables(self) -> Tables:
        leads, born = np.array(self.leads, np.int32), np.array(self.born, np.int32)
        origin, removed, split_at = (np.array(x, np.int32) for x in (self.origin, self.removed, self.split_at))
        live = np.unique(leads[born >= 0])
        keys, times, here, own = [], [], live, live.astype(np.int64)
        while len(here):  # up the origins of all live states at once
            here, own = here[here > 0], own[here > 0]
            keys.append(own << 32 | removed[here])
            times.append(split_at[here])
            here = origin[here]
        bits = 1 + sum(map(len, keys)).bit_length()
        removals, removed_at = scattered(np.concatenate(keys), np.concatenate(times), bits)
        ends = np.cumsum([0, *map(len, self.label)])
        high, low, token = trie([(x, i) for i, x in enumerate(self.label) if self.born[i] >= 0])
        return Tables(bits, removals, removed_at, leads, born, np.array(self.left, np.int32), high, low, token, np.frombuffer(b"".join(self.label), np.uint8), ends, np.diff(ends).astype(np.int32))

    def encode_word(self, word: bytes) -> list[int]:
        """The ids on the only path that spells the word."""
        own = self.__dict__.get("_tables") or self.__dict__.setdefault("_tables", self.tables())
        data = np.frombuffer(word, np.uint8)
        return own.encode_words(data, np.array([0, len(data)]))[0].tolist() if len(data) else []


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a search for each key begins in a hash table of 1 << bits slots and what runs over its end."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def scattered(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash table with linear probing: keys (-1: empty) and values by slot."""
    slot = slots(keys, bits)
    order = np.argsort(slot, kind="stable")
    place = np.maximum.accumulate(slot[order] - np.arange(len(keys))) + np.arange(len(keys))
    size = max(1 << bits, int(place.max(initial=0)) + 1) + 1
    own, held = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    own[place], held[place] = keys[order], values[order]
    return own, held


def trie(words: Sequence[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, token): high[node, upper half of a byte] is a row of low, low[row, lower half] the next node, 0 where there is none.

    Node 0 is no node, node 1 the root; token[node] is the id of the word that ends there, or -1.
    """
    high, low, token = [[0] * 16, [0] * 16], [[0] * 16], [-1, -1]
    for word, i in words:
        node = 1
        for byte in word:
            row = high[node][byte >> 4]
            if not row:
                row = high[node][byte >> 4] = len(low)
                low.append([0] * 16)
            after = low[row][byte & 15]
            if not after:
                after = low[row][byte & 15] = len(high)
                high.append([0] * 16)
                token.append(-1)
            node = after
        token[node] = i
    return np.array(high, np.int32), np.array(low, np.int32), np.array(token, np.int32)


@dataclass
class Tables:
    """The compiled automaton; its size depends on the vocabulary only."""

    bits: int
    removals: np.ndarray  # hash table of state << 32 | token
    removed_at: np.ndarray
    leads: np.ndarray
    born: np.ndarray
    left: np.ndarray
    high: np.ndarray
    low: np.ndarray
    token: np.ndarray
    spelt: np.ndarray  # all labels, one after the other
    ends: np.ndarray
    sizes: np.ndarray

    def allowed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has a transition on the token beside it."""
        out = np.ones(len(states), bool)
        at, own, limit = np.arange(len(states)), states.astype(np.int64) << 32, np.full(len(states), np.iinfo(np.int32).max, np.int32)
        while len(at):
            lacks = self.removal_time(own | tokens) <= limit
            out[at[lacks]] = False
            born = self.born[tokens]
            more = ~lacks & (born > 0)
            at, own, limit, tokens = at[more], own[more], born[more], self.left[tokens[more]]
        return out

    def removal_time(self, keys: np.ndarray) -> np.ndarray:
        """When each state lost its token; beyond all times if it never did."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        place, at = slots(keys, self.bits), np.arange(len(keys))
        while len(at):
            held = self.removals[place]
            hit = held == keys[at]
            out[at[hit]] = self.removed_at[place[hit]]
            on = ~hit & (held >= 0)
            at, place = at[on], place[on] + 1
        return out

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, token) of every occurrence of a token in the words, by length; ends[p] is the end of p's word."""
        at, node, depth, found = np.arange(len(data)), np.ones(len(data), np.int32), 0, []
        while len(at):
            byte = data[at + depth]
            node = self.low[self.high[node, byte >> 4], byte & 15]
            depth += 1
            token = self.token[node]
            hit = token >= 0
            found.append((at[hit] + depth, token[hit]))
            on = (node > 0) & (at + depth < ends[at])
            at, node = at[on], node[on]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words data[offsets[k] : offsets[k + 1]], none empty."""
        sizes = np.diff(offsets)
        begins = np.repeat(offsets[:-1], sizes)
        end, token = self.matches(data, begins + np.repeat(sizes, sizes))
        start = end - self.sizes[token]
        place = end - begins[end - 1]
        last = np.full(len(data), -1, np.int32)
        short = place <= LONG_WORD
        order = np.argsort(place[short].astype(np.uint8), kind="stable")
        bounds = np.searchsorted(place[short][order], np.arange(1, LONG_WORD + 2))
        start_s, end_s, token_s, first = start[short][order], end[short][order], token[short][order], begins[end[short][order] - 1]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # one byte position of all words at a time
            s, t = start_s[lo:hi], token_s[lo:hi]
            inner = s > first[lo:hi]
            ok = self.allowed(np.where(inner, self.leads[last[s - inner]], 0), t)
            last[end_s[lo:hi][ok] - 1] = t[ok]
        if not short.all():
            self._further(last, start[~short], end[~short], token[~short], begins)
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte of these words")
        on_path, here, first = np.zeros(len(data), bool), offsets[1:] - 1, offsets[:-1]
        while len(here):
            on_path[here] = True
            here = here - self.sizes[last[here]]
            on = here >= first
            here, first = here[on], first[on]
        return last[on_path], np.add.reduceat(on_path, offsets[:-1], dtype=np.int64) if len(sizes) else np.zeros(0, np.int64)

    def _further(self, last: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray, begins: np.ndarray) -> None:
        """The same beyond LONG_WORD bytes, where few words are: one match after the other."""
        order = np.argsort(end, kind="stable")
        known: dict[tuple[int, int], bool] = {}
        for s, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
            state = int(self.leads[last[s - 1]]) if s > begins[e - 1] else 0
            if (goes := known.get((state, t))) is None:
                goes = known[state, t] = bool(self.allowed(np.array([state]), np.array([t], np.int32))[0])
            if goes:
                last[e - 1] = t

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the labels on a path of ids."""
        return self.spelt[ragged(self.ends[ids], self.sizes[ids])]


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes begins[k] .. begins[k] + sizes[k] - 1 of all k, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def code_point_classes() -> np.ndarray:
    """The class of each code point as the pre-splitting sees it.

    Letters and digits that the interpreter's own Unicode tables leave unassigned depend on the version of the tables: there the library decides, if the driver has it.
    """
    import unicodedata

    import regex

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    out = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for pattern, kind in ((r"\s+", BLANK), (r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
        out[code_points("".join(regex.findall(pattern, every, flags=regex.V1)))] = kind
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    try:
        from tokenizers.pre_tokenizers import ByteLevel
    except ImportError:
        return out
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in doubtful:
        joined = {head for head in "a1!" if len(split(head + c)) == 1}
        out[ord(c)] = LETTER if "a" in joined else DIGIT if "1" in joined else OTHER
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pre-splitting starts a word; the pieces are parted by single BREAKs, which are words of their own.

    A word is a run of letters, digits or other signs, with one blank before it if there is one, or an ending after an
    apostrophe; a run of white space before it keeps the rest, and at the end of a piece all.
    """
    starts = np.ones(len(points), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    solid = (kind > BLANK) & (kind < BREAK)
    after = np.flatnonzero(solid[1:] & (kind[:-1] == BLANK)) + 1
    starts[after - 1] = True
    starts[after] = points[after - 1] != 32
    at = np.flatnonzero(starts & (points == 39) & solid)
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    for ending in ENDINGS:
        hit = at
        for k, c in enumerate(ending[1:], 1):
            hit = hit[padded[hit + k] == ord(c)]
        hit = hit[kind[np.minimum(hit + len(ending) - 1, len(kind) - 1)] != BREAK]
        starts[hit + 1] = False
        past = hit[hit + len(ending) < len(points)] + len(ending)
        starts[past] = True
    return starts


class Codec:
    """What a task needs: the tables, and the words met lately."""

    def __init__(self, tables: Tables, kinds: np.ndarray, added: dict[str, int]) -> None:
        import regex

        self.tables, self.kinds, self.added = tables, kinds, added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.seam = regex.compile(r"(?<=\S)\s")
        self.reset(0)

    def reset(self, seed: int) -> None:
        rng = np.random.default_rng(1009 + seed)
        self.seed, self.values = seed, rng.integers(0, 2**63, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**62)) * 8 + 5
        self.base, self.inverse = base & 0xFFFFFFFFFFFFFFFF, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.known, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x & 0xFFFFFFFFFFFFFFFF, np.uint64)])) for x in (self.base, self.inverse))
        return self.up, self.down

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text of about STEP_CHARS at most, and the id of the added token behind each (-1: none)."""
        at = 0
        for hit in self.cut.finditer(text) if self.cut is not None else ():
            *head, (tail, _) = self.parts(text[at : hit.start()])
            yield from head
            yield tail, self.added[hit.group()]
            at = hit.end()
        yield from self.parts(text[at:] if at else text)

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        at = 0
        while len(text) - at > STEP_CHARS and (hit := self.seam.search(text, at + STEP_CHARS)):
            yield text[at : hit.start()], -1
            at = hit.start()
        yield (text[at:] if at else text), -1

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, spelt) of texts: all ids, how many each text has, and the bytes that they spell."""
        whole = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        for seed in range(self.seed, self.seed + 4):
            if seed != self.seed:
                self.reset(seed)
            counts, found, held, step = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], 0, []
            for k, text in enumerate(texts):
                for piece, behind in self.pieces(text):
                    if step and held + len(piece) > STEP_CHARS:
                        found.append(self.encode_step(step, counts))
                        step, held = [], 0
                    step.append((k, piece, behind))
                    held += len(piece) + 1
            if step:
                found.append(self.encode_step(step, counts))
            ids = np.concatenate(found)
            spelt = self.tables.spell(ids)
            if np.array_equal(spelt, whole):
                return ids, counts, spelt
        raise ValueError("the labels do not spell the texts")

    def encode_step(self, step: Sequence[tuple[int, str, int]], counts: np.ndarray) -> np.ndarray:
        """The ids of the pieces of a step; counts are added to by text."""
        joined = "\n".join([*[piece for _, piece, _ in step], ""])
        points = code_points(joined)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        kind = self.kinds[points]
        breaks = np.cumsum([len(piece) + 1 for _, piece, _ in step]) - 1
        kind[breaks] = BREAK
        begins = np.flatnonzero(word_starts(points, kind))
        is_break = kind[begins] == BREAK
        if len(data) > len(points):  # from code points to bytes
            wide = np.ones(len(points), np.int64)
            for least in (0x80, 0x800, 0x10000):
                wide += points >= least
            begins = (np.cumsum(wide) - wide)[begins]
        ends = np.append(begins[1:], len(data))
        word_ids, word_counts = self.of_words(data, begins[~is_break], ends[~is_break])
        behind = np.array([b for _, _, b in step], np.int32)
        all_counts = np.zeros(len(begins), np.int64)
        all_counts[~is_break] = word_counts
        all_counts[is_break] = behind >= 0
        out = np.empty(int(all_counts.sum()), np.int32)
        is_added = np.zeros(len(out), bool)
        before = np.cumsum(all_counts) - all_counts
        is_added[before[is_break][behind >= 0]] = True
        out[is_added], out[~is_added] = behind[behind >= 0], word_ids
        up_to = np.cumsum(all_counts)[is_break]
        np.add.at(counts, np.array([k for k, _, _ in step]), np.diff(up_to, prepend=0))
        return out

    def of_words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words data[begins[k] : ends[k]]; each distinct word that isn't known is encoded once."""
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        up, down = self.powers(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * up[: len(data)])])
        name = (total[ends] - total[begins]) * down[begins] ^ (ends - begins).astype(np.uint64)
        own, first, back = np.unique(name, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, own)
        place[place == len(self.known)] = 0
        new = self.known[place] != own if len(self.known) else np.ones(len(own), bool)
        if new.any():
            b, e = begins[first[new]], ends[first[new]]
            ids, counts = self.tables.encode_words(data[ragged(b, e - b)], np.concatenate([[0], np.cumsum(e - b)]))
            self.learn(own, new, place, ids, counts)
            place = np.searchsorted(self.known, own)
        counts = self.count[place]
        return self.ids[ragged(self.begin[place][back], counts[back])], counts[back]

    def learn(self, own: np.ndarray, new: np.ndarray, place: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.known) + int(new.sum()) > MOST_WORDS:  # only the words of this step stay
            stay = np.sort(place[~new])
            self.ids = self.ids[ragged(self.begin[stay], self.count[stay])]
            self.known, self.count = self.known[stay], self.count[stay]
            self.begin = np.cumsum(self.count) - self.count
        known, begin, count = np.concatenate([self.known, own[new]]), np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts]), np.concatenate([self.count, counts])
        order = np.argsort(known, kind="stable")
        self.known, self.begin, self.count, self.ids = known[order], begin[order], count[order], np.concatenate([self.ids, ids])


@lru_cache(maxsize=1)
def compiled(spec: str) -> tuple[Tables, np.ndarray, dict[str, int]]:
    """What the driver compiles and Spark broadcasts."""
    told = json.loads(spec)
    return Automaton(told["vocab"], told["merges"], told["added"]).tables(), code_point_classes(), told["added"]


def load_vocabulary(path: str) -> str:
    """Vocabulary, merges and plain added tokens of a tokenizer file, as JSON; read by the driver."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    for x in told.get("added_tokens", []):
        if x.get("lstrip") or x.get("rstrip") or x.get("single_word"):
            raise ValueError(f"added tokens that take their surroundings aren't supported: {x}")
    return json.dumps({"vocab": told["model"]["vocab"], "merges": merges, "added": {x["content"]: x["id"] for x in told.get("added_tokens", [])}})


def offsets_of(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings of so many bytes each; bytes that are no UTF-8 become U+FFFD."""
    ends = np.cumsum(sizes)
    try:
        str(data.data, "utf-8")
        whole = not (data[ends[ends < len(data)]] & 0xC0 == 0x80).any()  # none begins within a code point
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends - sizes, ends, strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(sizes), offsets_of(sizes).buffers()[1], pa.py_buffer(np.ascontiguousarray(data)))


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",), ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Returns the carried columns and ids_col (array of int): one row for each input row.

    decoded_col also gets what the ids decode to, by the same worker: a second one for decode() would hold its tables too.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(compiled(vocabulary))  # its size depends on the vocabulary only
    carry = [c for c in carry if c != text_col]
    refuse(carry, [ids_col, *([decoded_col] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(*held.value)
        for batch in batches:
            ids, counts, spelt = own.encode([t or "" for t in batch.column(text_col).to_pylist()])
            columns = [pa.ListArray.from_arrays(offsets_of(counts), pa.array(ids))]
            if decoded_col:
                ends = np.concatenate([[0], np.cumsum(own.tables.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                columns.append(strings(spelt, np.diff(ends)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *columns], names=[*carry, ids_col, *([decoded_col] if decoded_col else [])])

    used = pick(docs, [*carry, text_col])
    schema = T.StructType([*[used.schema[c] for c in carry], T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])
    return used.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids", carry: Sequence[str] = ("doc_id",), text_col: str = "decoded") -> DataFrame:
    """Returns the carried columns and text_col: the labels of the ids' arcs; null ids count as none."""
    ship(encoded.sparkSession)
    told = json.loads(vocabulary)
    spelt = labels(told["vocab"], told["added"])
    held = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(spelt), np.uint8), np.cumsum([0, *map(len, spelt)])))
    carry = list(carry)
    refuse(carry, [text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, ends = held.value
        sizes = np.diff(ends)
        for batch in batches:
            column = batch.column(ids_col)
            ids, counts = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            texts = strings(data[ragged(ends[ids], sizes[ids])], np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], texts], names=[*carry, text_col])

    used = pick(encoded, [*dict.fromkeys([*carry, ids_col])])
    schema = T.StructType([*[used.schema[c] for c in carry], T.StructField(text_col, T.StringType())])
    return used.mapInArrow(run, schema)
