"""Byte-pair encoding of whole texts by tree concatenation, equal to what the tokenizers library gives."""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_texts, to_batch

#: Letters of an unsplit run from which it is encoded by halves, and of a leaf; bytes of a text for the same.
LONG, LEAF = 1024, 512
LONG_TEXT, TEXT_LEAF = 4096, 2048
#: Letters or bytes of the first window at either side of a join.
WINDOW = 32
#: Chunks whose tokens a task remembers.
REMEMBERED = 500_000


class Encoder:
    """Encodes texts as Tokenizer.from_file(path) does with add_special_tokens=False.

    If the tokenizer drops white space (``word``), what lies between, a chunk, is encoded once and
    remembered. A text of LONG_TEXT or more bytes is encoded by tree concatenation (see
    concatenated) of its halves, cut anywhere, with chunks as units; a run of LONG or more
    letters by tree concatenation of its halves with tokens as units. If white space belongs to the next token (``byte``), texts are cut only at
    spaces where the tokenizer is sure to cut as well; where the vocabulary allows, they go to
    tiktoken instead, which gives the same ids in half the time.
    """

    def __init__(self, path: str, spaces: str = "word"):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        #: The model alone, for runs that are already normalised, cut and mapped to its letters.
        self.model = Tokenizer(self.whole.model)
        self.spaces = spaces
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        size = self.whole.get_vocab_size(with_added_tokens=True)
        #: A token's text, if decoding joins these by spaces, which the library does without a decoder.
        self.names = [(self.whole.id_to_token(k) or "").encode() for k in range(size)] if self.whole.decoder is None else None
        self.ranked = ranked(self.whole) if spaces == "byte" else None
        self.lowers = "Lowercase" in json.dumps(json.loads(self.whole.to_str())["normalizer"])
        #: Of a chunk: its ids, as little-endian unsigned 32-bit integers, and its tokens' texts.
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [ids for ids, _ in self.encode_named(texts, named=False)]

    def encode_named(self, texts: list[bytes], named: bool = True):
        """Each text's ids and, if named, the bytes of what they decode to."""
        if self.ranked:
            for text in texts:
                string = text.decode()
                if self.special and self.special.search(string):
                    ids = np.array(self.whole.encode(string, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    ids = array("I", self.ranked.encode_ordinary(string)).tobytes()
                yield ids, self.decode(ids) if named else b""
            return
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            pairs = self.long_text(text) if len(text) >= LONG_TEXT and self.spaces == "word" else self.encoded(self.chunks(text))
            ids = b"".join([p[0] for p in pairs])
            if not named:
                yield ids, b""
            elif self.names is None:
                yield ids, self.decode(ids)
            else:
                yield ids, b" ".join([p[1] for p in pairs if p[1]])

    def chunks(self, text: bytes) -> list[bytes]:
        if self.spaces == "word":
            return self.lowered(text).split()
        if UNSURE.search(text):
            return [text]
        first, *rest = text.split(b" ")
        return [first, *(b" " + x for x in rest)]

    def lowered(self, text: bytes) -> bytes:
        return text.lower() if self.lowers and not (self.special and self.special.search(text.decode())) else text

    def encoded(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each chunk's ids and its tokens' texts; unknown chunks are encoded side by side."""
        pairs = list(map(self.known.get, chunks))
        if None in pairs:
            lacking = [k for k, p in enumerate(pairs) if p is None]
            self.learn(list({chunks[k] for k in lacking}))
            for k in lacking:
                pairs[k] = self.known[chunks[k]]
        return pairs

    def long_text(self, text: bytes) -> list[tuple[bytes, bytes]]:
        """The encoded chunks of a long text, by tree concatenation."""
        text = self.lowered(text)

        def units(spans: list[tuple[int, int]]) -> list[list[tuple]]:
            found = [[(a + m.start(), a + m.end()) for m in CHUNK.finditer(text[a:b])] for a, b in spans]
            pairs = iter(self.encoded([text[a:b] for part in found for a, b in part]))
            return [[(a, b, next(pairs)) for a, b in part] for part in found]

        def whole(at: int) -> int:
            """at, or the start of the letter that it would cut."""
            while at < len(text) and text[at] & 0xC0 == 0x80:
                at -= 1
            return at

        return [pair for _, _, pair in concatenated(len(text), TEXT_LEAF, units, whole)]

    def learn(self, chunks: list[bytes]) -> None:
        """Adds chunks to known. Those of visible ASCII letters need no normalisation other than lower case."""
        found: dict[bytes, list[int]] = {}
        tokenize = self.whole.model.tokenize
        slow = []
        for chunk in chunks:
            if self.spaces == "word" and self.lowers and len(chunk) < LONG and PLAIN.fullmatch(chunk) and not (self.special and self.special.search(chunk.decode())):
                found[chunk] = [t.id for run in RUNS.findall(chunk.decode()) for t in tokenize(run)]
            else:
                slow.append(chunk)
        short = [c for c in slow if len(c) < LONG]
        for c, e in zip(short, self.whole.encode_batch_fast([c.decode() for c in short], add_special_tokens=False), strict=True):
            found[c] = e.ids
        for c in slow:
            if len(c) >= LONG:
                found[c] = self.long_chunk(c.decode())
        names = self.names
        for c, ids in found.items():
            self.known[c] = array("I", ids).tobytes(), b" ".join([names[k] for k in ids]) if names else b""

    def long_chunk(self, chunk: str) -> list[int]:
        """Special tokens, then normalisation and cutting as the tokenizer does; long runs by halves."""
        ids: list[int] = []
        at = 0
        for m in [*(self.special.finditer(chunk) if self.special else ()), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
            for run, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                ids += [t[2] for t in self.tree(run)] if len(run) >= LONG else self.model.encode(run, add_special_tokens=False).ids
            if m:
                ids.append(self.whole.token_to_id(m[0]))
                at = m.end()
        return ids

    def tokens(self, runs: list[tuple[int, str]]) -> list[list[tuple[int, int, int]]]:
        """(start, end, id) of each token of each run that starts at the given place; runs go side by side."""
        found = self.model.encode_batch([s for _, s in runs], add_special_tokens=False)
        return [[(at + a, at + b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)] for (at, _), e in zip(runs, found, strict=True)]

    def tree(self, run: str) -> list[tuple[int, int, int]]:
        """The tokens of a long run, by tree concatenation."""
        return concatenated(len(run), LEAF, lambda spans: self.tokens([(a, run[a:b]) for a, b in spans]))

    def decode(self, ids: bytes) -> bytes:
        """What the tokenizer's decode(ids, skip_special_tokens=False) gives, in UTF-8."""
        return self.whole.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()


def concatenated(length: int, leaf: int, units, whole=lambda at: at) -> list[tuple]:
    """The units (start, end, what) of something long: halves down to ``leaf``, all leaves at once, then level by level the joins.

    units gives those of each of several spans, encoded apart, side by side; whole moves a cut to
    where a span may end. Whether two units may stand side by side depends on these two alone.
    """
    cuts = [0, length]
    while True:
        finer = sorted({*cuts, *(whole((a + b) // 2) for a, b in zip(cuts, cuts[1:]) if b - a > leaf)})  # noqa: B905, RUF007
        if finer == cuts:
            break
        cuts = finer
    spans = list(zip(cuts, cuts[1:]))  # noqa: B905, RUF007
    parts = [(a, b, own) for (a, b), own in zip(spans, units(spans), strict=True)]
    while len(parts) > 1:
        joined = join_all(list(zip(parts[::2], parts[1::2])), units, whole)  # noqa: B905
        parts = joined + parts[len(joined) * 2 :]
    return parts[0][2]


def join_all(pairs: list[tuple], units, whole) -> list[tuple]:
    """Pairs of neighbouring parts (start, end, units), encoded apart, as if encoded together; the joins of a level go side by side.

    A window around each join is encoded; it grows until it has a unit in common with the left
    part and one with the right part, at the same place. Every two neighbours of the result are
    neighbours in the left part, the window or the right part; so the result is the encoding.
    """
    out: list = [None] * len(pairs)
    size, open_ = WINDOW, list(range(len(pairs)))
    while open_:
        spans = [(whole(max(pairs[k][0][0], pairs[k][0][1] - size)), whole(min(pairs[k][1][1], pairs[k][0][1] + size))) for k in open_]
        for k, (a, b), window in zip(open_, spans, units(spans), strict=True):
            (first, _, left), (_, last, right) = pairs[k]
            place = {unit: n for n, unit in enumerate(window)}
            at_left = next((n for n in range(len(left) - 1, -1, -1) if left[n] in place), None) if a > first else -1
            at_right = next((n for n in range(len(right)) if right[n] in place), None) if b < last else len(right)
            if at_left is None or at_right is None:
                continue
            start = place[left[at_left]] + 1 if at_left >= 0 else 0
            end = place[right[at_right]] if at_right < len(right) else len(window)
            if start <= end:
                out[k] = (first, last, left[: at_left + 1] + window[start:end] + right[at_right:])
        open_ = [k for k in open_ if out[k] is None]
        size *= 2
    return out


def ranked(tokenizer):
    """A tiktoken encoding with the tokenizer's merges, if it is byte-level BPE whose ids are in the order of its merges."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    kind = json.loads(tokenizer.to_str())["pre_tokenizer"]
    if kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space") or tokenizer.normalizer or model.get("ignore_merges"):
        return None
    # A visible Latin-1 byte stands for itself; the others, in order, are the letters from U+0100 on.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = {token: k for token, k in model["vocab"].items() if token not in special}
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or len(letters) != 256:
        return None
    ranks = {bytes(letters[c] for c in token): k for token, k in ids.items()}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


#: Fixed: the pattern by which byte-level BPE of this kind cuts text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A lower-case chunk of visible ASCII letters, and how the word tokenizer's pattern (fixed) cuts it.
PLAIN = re.compile(rb"[!-@\[-~]+")
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

#: What lies between white space.
CHUNK = re.compile(rb"[^ \t-\r]+")

#: A space that has no visible ASCII character before it and perhaps more white space after it.
UNSURE = re.compile(rb"(?<![!-~]) (?=[\x00-\x20\xc2\xe1-\xe3]|\Z)")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """One for each tokenizer file in a Python worker."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


def encode_and_decode(docs: DataFrame, path: str, spaces: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: the whole text's ids and what they decode to.

    ids are little-endian unsigned 32-bit integers. A null text counts as empty, which has no
    ids. Ids of rows may repeat or be null; other columns are not read. path names a tokenizer
    file that every executor has.
    """

    def work(batches):
        own = encoder(path, spaces)
        for batch in batches:
            ids, decoded = zip(*own.encode_named(as_bytes(batch.column(1))), strict=True) if batch.num_rows else ([], [])
            yield to_batch(doc_id=batch.column(0), ids=pa.array(ids, pa.binary()), decoded=pa.array([x.decode() for x in decoded], pa.string()))

    return map_texts(docs, work, "doc_id long, ids binary, decoded string", F.col(id_col).cast("long"), F.col(text_col))


def encoding_digests(docs: DataFrame, path: str, spaces: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_and_decode without the bytes. Other columns are not read; an empty table gives an empty result."""

    def work(batches):
        own = encoder(path, spaces)
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, text in own.encode_named(as_bytes(batch.column(1)))]
            n, ids, text = zip(*rows, strict=True) if rows else ([], [], [])
            yield to_batch(doc_id=batch.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(text, pa.string()))

    return map_texts(docs, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", F.col(id_col).cast("long"), F.col(text_col))
