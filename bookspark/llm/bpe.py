"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A token sequence is the BPE encoding of a word exactly if each neighbouring
pair of tokens is: no merge across their border comes before the merges that
made them. So each prefix of a word has one possible last token, and every
token that is still to come starts among the last `lookahead` positions,
`lookahead` being the longest token of the merge list. The transducer keeps the
last tokens of those positions and what they lead back to; when all lead back
to one border, everything before it is stable and is emitted and forgotten.
Memory doesn't grow with the word.

Decoding is a state machine that takes ids one by one: bytes of unfinished
characters wait in its state, finished characters come out.

The vocabulary is a file of the tokenizers library's format: byte-level BPE
with a word-end mark; NFC, white space to one space, lower case. It is read
on the driver and sent to the tasks: its size is that of the file.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from bookspark.llm._shared import add_columns, without

#: Distinct chunks of text whose ids a task keeps; then it starts anew.
CACHED = 200_000
#: Longer chunks of text aren't kept.
CACHED_CHARS = 48

_SPACE = re.compile("[\t-\r\x85\xa0  -     　]")


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _reach(texts: Iterable[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for text in texts:
        out[text[:5]] = max(len(text), out.get(text[:5], 0))
    return out


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.has_decoder = bool(spec.get("decoder"))
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.order = dict.fromkeys(self.vocabulary.values(), 0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges, 1):
            left, right = self.vocabulary[a], self.vocabulary[b]
            whole = self.vocabulary[a + b]
            self.merged[left, right] = rank
            self.parts[whole] = left, right
            self.order[whole] = rank
        self.fits: dict[int, bool] = {}
        #: Tokens that the merges can make, by text; those at the end of a word apart.
        inner, last = {}, {}
        for text, i in self.vocabulary.items():
            if i not in self.parts or self._apart(*self.parts[i], self.order[i]):
                if self.suffix and text.endswith(self.suffix) and text != self.suffix:
                    last[text[: -len(self.suffix)]] = i
                else:
                    inner[text] = i
        self.inner, self.last = inner, last if self.suffix else inner
        #: The longest inner one for each start of five characters.
        self.reach = _reach(self.inner)
        #: Characters that decide what can still change: the longest token.
        self.lookahead = max(map(len, [*inner, *last]), default=1)
        self.table = _byte_characters()
        self.bytes = {c: b for b, c in self.table.items()}
        # a file whose words are split in another way can be decoded only
        split = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.words = regex.compile(split[0]) if split else None
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge of rank under `before` joins the end of a with the start of b while both are being made."""
        order, parts = self.order, self.parts
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < before:
                return False
            if a not in parts and b not in parts:
                return True
            if order[a] > order[b]:
                before, a = order[a], parts[a][1]
            else:
                before, b = order[b] + 1, parts[b][0]

    def follows(self, a: int, b: int) -> bool:
        """b can come after a."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) > CACHED:
                self.fits.clear()
            known = self.fits[a << 32 | b] = self._apart(a, b, 1 << 60)
        return known

    def word(self, text: str) -> Iterator[int]:
        """Ids of one word of byte characters; where its end is in sight, the one path to it is tried first."""
        return iter(self._whole(text)) if len(text) <= self.lookahead else self.stream(text)

    def stream(self, text: str) -> Iterator[int]:
        """Ids of one word of byte characters, each as soon as it is stable."""
        n, most, fits, follows = len(text), self.lookahead, self.fits, self.follows
        base, tokens, starts = 0, [-1], [0]  # of positions base, base + 1, ...
        find = self.inner.get
        for end in range(1, n + 1):
            if end == n:
                find = self.last.get
            for start in range(end - most if end - most > base else base, end):
                token = find(text[start:end])
                if token is not None:
                    before = tokens[start - base]
                    if start == 0 or fits.get(before << 32 | token) or follows(before, token):
                        tokens.append(token)
                        starts.append(start)
                        break
            if end - base >= 8 * most and end < n:
                border = self._border(tokens, starts, base, end)
                if border > base:
                    yield from self._path(tokens, starts, base, border)
                    tokens, starts, base = tokens[border - base :], starts[border - base :], border
        yield from self._path(tokens, starts, base, n)

    def _whole(self, text: str) -> list[int]:
        """Ids of a word that fits the lookahead: the one path to its end, longest tokens tried first."""
        n, inner, last, fits, follows = len(text), self.inner.get, self.last.get, self.fits, self.follows
        path, borders, dead, size, at = [-1], [0], set(), n, 0
        while True:
            before = path[-1]
            if size >= n - at:
                token = last(text[at:])
                if token is not None and (at == 0 or fits.get(before << 32 | token) or follows(before, token)):
                    path.append(token)
                    return path[1:]
                size = min(n - at - 1, self.reach.get(text[at : at + 5], 4))
            while size > 0:
                token = inner(text[at : at + size])
                if token is not None and at + size not in dead and (at == 0 or fits.get(before << 32 | token) or follows(before, token)):
                    break
                size -= 1
            if size > 0:
                path.append(token)
                at += size
                borders.append(at)
                size = n
            else:  # no way on from here
                dead.add(at)
                size = at - borders[-2] - 1
                path.pop()
                borders.pop()
                at = borders[-1]

    def _border(self, tokens: list[int], starts: list[int], base: int, end: int) -> int:
        """The last position that all positions still in reach lead back to."""
        live = set(range(end - self.lookahead + 1, end + 1))
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            live.add(starts[p - base])
        return live.pop()

    @staticmethod
    def _path(tokens: list[int], starts: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(tokens[end - base])
            end = starts[end - base]
        return out[::-1]

    def chunk(self, text: str) -> list[int]:
        """Ids of a piece of normal text without white space."""
        known = self.known.get(text)
        if known is None:
            known = []
            for word in self.words.findall(text):
                ids = self.known.get(word)
                if ids is None or word == text:
                    ids = [*self.word(word.encode().decode("latin-1").translate(self.table))]
                    if len(word) <= CACHED_CHARS:
                        self.known[word] = ids
                known += ids
            if len(text) <= CACHED_CHARS:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        if self.words is None:
            raise ValueError("encoding needs a vocabulary file whose words are split by a pattern")
        out: list[int] = []
        for part in self.specials.split(text) if self.specials and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            plain = _SPACE.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            known = self.known
            for piece in plain.split(" "):
                if piece:
                    out += known.get(piece) or self.chunk(piece)
        return out

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece.

        A file without a decoder, like its library, gives the tokens' strings
        with a space between; else bytes become characters as they are
        complete, a word end a space, and a broken character U+FFFD.
        """
        if not self.has_decoder:
            gap = ""
            for i in ids:
                if (token := self.strings.get(i)) is not None:
                    yield gap + token
                    gap = " "
            return
        state = codecs.getincrementaldecoder("utf-8")("replace")
        special = {i: t for t, i in self.special.items()}
        for i in ids:
            if i in special:
                yield state.decode(b"", True) + special[i]
                continue
            token = self.strings.get(i, "")
            ends = bool(self.suffix) and token.endswith(self.suffix)
            token = token.removesuffix(self.suffix) if ends else token
            yield state.decode(bytes(self.bytes[c] for c in token)) + " " * ends
        yield state.decode(b"", True)


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE":
        raise ValueError("not a BPE vocabulary")
    return spec


_made: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    """The vocabulary's transducer, one in each Python worker."""
    if shared.value["key"] not in _made:
        _made.clear()
        _made[shared.value["key"]] = Transducer(shared.value["spec"])
    return _made[shared.value["key"]]


def _share(df: DataFrame, path: str):
    spec = read_vocabulary(path)
    return df.sparkSession.sparkContext.broadcast({"key": path, "spec": spec})


def encode(documents: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """documents with ids array<int>, and with decoded string if `decode`: those ids decoded in the same pass.

    A null or empty text has no ids, and decodes to an empty text. Repeated
    rows stay. Columns of these names are replaced.
    """
    shared = _share(documents, path)

    def make():
        coder = _transducer(shared)

        def run(texts):
            ids = [coder.encode(t.decode()) if t else [] for t in texts]
            return (ids, ["".join(coder.decoded(x)) for x in ids]) if decode else (ids,)

        return run

    return add_columns(documents if decode else without(documents, ["ids"]), text, "ids array<int>" + ", decoded string" * decode, make)


def decode(documents: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """documents with decoded string, the text of `ids`; null ids and unknown ids give nothing."""
    shared = _share(documents, path)

    def make():
        coder = _transducer(shared)
        return lambda rows: (["".join(coder.decoded(x or [])) for x in rows],)

    return add_columns(documents, ids, "decoded string", make, kind="array<int>")
