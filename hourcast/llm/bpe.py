"""BPE encoding and decoding by prefix-sharing traversal of a trie of words.

The vocabulary is a ``tokenizers`` JSON file of the kind with word ends
(``word_bpe_49k.json``): its normaliser (NFC, white space to one blank, lower
case), its split into words, its byte symbols with a marked last symbol, its
merges.  The file is read by each worker; only its path is shipped.

Every prefix of a word has one encoding, and that encoding without its last
token is the encoding of a shorter prefix.  So the last token is all the state
a prefix needs: it is the one token ``t`` that ends the prefix and fits the
last token ``u`` of what stands before it, i.e. whose pair ``u t`` no merge
would have joined across the border.  The distinct words of a batch, in order,
are the leaves of their trie in depth-first order: a word shares the path of
the word before as far as both agree, and only the nodes after that are new
and get a state (the place in an automaton over all tokens, which names the
tokens that end here, and the last token).  Shared prefixes are encoded once.

``fits`` looks back in time from a pair of finished tokens: the part next to
the border that was made last is undone first, and no pair of parts that stood
side by side may have had a merge of its own that came before the merge which
took one of them away.  That needs merges whose parts are made by earlier
merges, which ``Vocabulary`` checks.

Null and empty texts encode to no tokens.  Texts are encoded whole; the words
known to a worker are a memory of bounded size.  Repeated rows and null ids
give rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from hourcast.llm.common import ship

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words and token pairs that a worker remembers before it starts afresh.
WORDS_KEPT, PAIRS_KEPT = 200_000, 300_000
END = 256
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a vocabulary with word ends of the kind known here")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in [*ids.items(), *self.special.items()]}
        chars = byte_symbols()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.base = [ids[c] for c in chars] + [ids[c + suffix] for c in chars]
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(parts)))}
        made: dict[int, list[tuple[int, int, int]]] = {}
        for (a, b), (rank, t) in self.merge.items():
            made.setdefault(t, []).append((rank, a, b))
        #: Of each token: the rank of the merge that makes it (-1 for symbols) and its two parts.
        self.made = {t: (-1, t, t) for t in self.base}
        for t, ways in sorted(made.items(), key=lambda x: min(x[1])):
            if t not in self.made:
                self.made[t] = min(ways)
        self.symbols: dict[int, tuple[int, ...]] = {}
        for t in self.made:
            text = self.token[t]
            end = text.endswith(suffix) and text != suffix
            own = [byte_of[c] for c in (text[: -len(suffix)] if end else text)]
            self.symbols[t] = (*own[:-1], own[-1] + END * end)
        # a token that the merges don't reach from its own symbols can't be any prefix's last token
        self.made = {t: m for t, m in self.made.items() if m[0] < 0 or self._reached(t)}
        for rank, a, b in self.made.values():
            if rank >= 0 and not (a in self.made and b in self.made and max(self.made[a][0], self.made[b][0]) < rank):
                raise ValueError(f"{path}: a merge comes before its parts")
        self.length = {t: len(self.symbols[t]) for t in self.made}
        self._automaton()
        self._fit: dict[int, bool] = {}

    def _reached(self, t: int) -> bool:
        """Does merging the token's own symbols give the token, by the merge noted for it?"""
        seq, last = [self.base[s] for s in self.symbols[t]], None
        while len(seq) > 1:
            found = min(((self.merge[p][0], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in self.merge), default=None)
            if found is None:
                return False
            last, i = found
            seq[i : i + 2] = [self.merge[seq[i], seq[i + 1]][1]]
        return seq == [t] and last == self.made[t][0]

    def _automaton(self) -> None:
        """States are prefixes of tokens; ``ends`` has the tokens that end a state's text, longest first."""
        self.step: dict[int, int] = {}
        last: list[int | None] = [None]
        for t in self.made:
            q = 0
            for s in self.symbols[t]:
                key = q << 9 | s
                if key not in self.step:
                    self.step[key] = len(last)
                    last.append(None)
                q = self.step[key]
            last[q] = t
        children: dict[int, list[tuple[int, int]]] = {}
        for key, q in self.step.items():
            children.setdefault(key >> 9, []).append((key & 511, q))
        self.fail = [0] * len(last)
        self.ends: list[tuple[int, ...]] = [()] * len(last)
        order = [0]
        for q in order:
            own = (last[q],) if last[q] is not None else ()
            self.ends[q] = own + (self.ends[self.fail[q]] if q else ())
            for s, child in children.get(q, ()):
                if q:
                    self.fail[child] = self.go(self.fail[q], s)
                order.append(child)

    def go(self, q: int, s: int) -> int:
        while q and (q << 9 | s) not in self.step:
            q = self.fail[q]
        return self.step.get(q << 9 | s, 0)

    def fits(self, u: int, t: int) -> bool:
        gone_u = gone_t = NEVER
        while True:
            joined = self.merge.get((u, t))
            # of two equal merges the left one comes first
            if joined and joined[0] < gone_u and joined[0] <= gone_t:
                return False
            made_u, made_t = self.made[u], self.made[t]
            if made_u[0] < 0 and made_t[0] < 0:
                return True
            if made_u[0] > made_t[0]:
                gone_u, u = made_u[0], made_u[2]
            else:
                gone_t, t = made_t[0], made_t[1]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of each distinct word, over the trie of all of them."""
        step, fail, ends, length, known = self.step, self.fail, self.ends, self.length, self._fit
        if len(known) > PAIRS_KEPT:
            known.clear()
        out = {}
        before, state, last = b"", [0], [-1]
        for word, path in sorted(((w, w.encode("utf-8", "surrogatepass")) for w in words), key=lambda x: x[1]):
            n, shared = len(path), 0
            for a, b in zip(path[:-1], before[:-1], strict=False):
                if a != b:
                    break
                shared += 1
            del state[shared + 1 :], last[shared + 1 :]
            q = state[shared]
            for i in range(shared, n):
                s = path[i] + END * (i == n - 1)
                while q and (q << 9 | s) not in step:
                    q = fail[q]
                q = step.get(q << 9 | s, 0)
                state.append(q)
                for t in ends[q]:
                    at = i + 1 - length[t]
                    if not at:
                        break
                    key = last[at] << 17 | t
                    ok = known.get(key)
                    if ok is None:
                        ok = known[key] = self.fits(last[at], t)
                    if ok:
                        break
                else:
                    raise AssertionError("no token ends this prefix")
                last.append(t)
            ids, i = [], n
            while i:
                ids.append(last[i])
                i -= length[last[i]]
            out[word] = tuple(reversed(ids))
            before = path
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


SPACES = regex.compile(r"\s+")


#: All characters, surrogates aside.
EVERY = range(0xD800), range(0xE000, 0x110000)


def ranges(runs: Iterable[str]) -> str:
    """Runs of neighbouring characters, as they are written inside a set of a pattern."""
    return "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in runs)


def characters(kind: str) -> str:
    """All characters of a kind (L letters, N numbers) in the library's Unicode, which is neither Python's nor that of ``regex``."""
    split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
    return ranges(run for run, _ in split.pre_tokenize_str("".join(map(chr, chain(*EVERY)))))


@lru_cache(maxsize=1)
def newer() -> re.Pattern:
    """Characters that Python's Unicode does not know: the library may compose or lower them."""
    unknown = "".join(c if unicodedata.category(c) == "Cn" else "\n" for c in map(chr, chain(*EVERY)))
    return re.compile(f"[{ranges(unknown.split())}]")


#: The vocabulary's own pattern, written out for lower-cased text of Latin-1 letters, which the
#: normaliser leaves as it is; the separators U+001C to U+001F are white space to Python alone.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\s0-9²³¹¼-¾a-zªµºß-öø-ÿ]+")
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xff]")


class Coder:
    """Encoding and decoding of texts; remembers words from one batch to the next."""

    def __init__(self, path: str = VOCABULARY):
        self.v = vocabulary(path)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.v.special, key=len, reverse=True)) + ")")
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, tuple[int, str, str]] = {}

    @cached_property
    def words(self) -> regex.Pattern:
        """The vocabulary's own pattern, for texts beyond Latin-1."""
        return regex.compile(self.v.pattern.replace(r"\p{L}", characters("L")).replace(r"\p{N}", characters("N")), regex.V0)

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text; a special token starts with a blank, which no word has."""
        out = []
        for piece in self.special.split(text) if "<|" in text else [text]:
            if piece in self.v.special:
                out.append(" " + piece)
            elif not NOT_LATIN.search(piece):
                out += LATIN_WORDS.findall(piece.lower())
            else:
                if newer().search(piece):
                    piece = normalizers.Lowercase().normalize_str(SPACES.sub(" ", normalizers.NFC().normalize_str(piece)))
                else:
                    # lower case is taken letter by letter, so a last sigma gets no form of its own
                    piece = SPACES.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ").lower()
                out += self.words.findall(piece)
        return out

    def learn(self, words: Iterable[str]) -> None:
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = set(words)
        self.known |= {w: (self.v.special[w[1:]],) for w in new if w[0] == " "}
        self.known |= self.v.encode_words(w for w in new if w[0] != " ")

    def show(self, words: set[str]) -> None:
        """For each word: its number of tokens, their ids and the tokens decoded, as text."""
        self.learn(words)
        if len(self.shown) + len(words) > WORDS_KEPT:
            self.shown.clear()
        for w in words - self.shown.keys():
            ids = self.known[w]
            self.shown[w] = len(ids), " ".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        self.learn(set(words))
        return [i for w in words for i in self.known[w]]

    def decode(self, ids: Iterable[int]) -> str:
        """As the file has no decoder: the tokens as they are, joined by blanks."""
        return " ".join([self.v.token[i] for i in ids])


#: Code points of texts that share one trie.
TRIE_CHARS = 2_000_000


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in runs of TRIE_CHARS code points, or of one text that is longer."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= TRIE_CHARS:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the tokens of each row's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            done = 0
            for run in groups(map(pa.StringScalar.as_py, batch.column("text"))):
                words = [coder.split(t) for t in run]
                coder.learn(set().union(*words))
                ids = [[i for w in ws for i in coder.known[w]] for ws in words]
                keys = batch.column("doc_id").slice(done, len(run)).cast(pa.int64())
                done += len(run)
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            texts = [coder.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, decoded string")


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op3_trie_bpe(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The digests of each row's tokens and of the text decoded from them, taken where both are made."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for run in groups(map(pa.StringScalar.as_py, batch.column("text"))):
                split = [coder.split(t) for t in run]
                coder.show(set().union(*split))
                for words in split:
                    got = [coder.shown[w] for w in words]
                    out.append((sum([x[0] for x in got]), sha(" ".join([x[1] for x in got])), sha(" ".join([x[2] for x in got]))))
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(each, OUT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document: (doc_id, ids)."""
    return encode(docs)
