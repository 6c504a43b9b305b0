"""Text cleaning and tokenising as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and marks, or one other visible character.
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
ANCHOR = r"(</a>)|(<a.*?href.*?>)"

#: English stop words, with the clitics that treebank tokenizers split off.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn 'll 're 've n't 's 'd 'm '' ``
""".split()


def let(value: Column, body) -> Column:
    """Compute ``value`` once and hand it to ``body``, which may name it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_anchors(text: Column) -> Column:
    return F.regexp_replace(text, ANCHOR, "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(tokens_: Column, uncased: bool = False) -> Column:
    return F.transform(tokens_, F.lower) if uncased else tokens_


def untokenize(tokens_with_space: Column) -> Column:
    """Text of tokens that carry the space after them."""
    return F.trim(F.array_join(tokens_with_space, ""))


def token_slice(tokens_: Column, start: int, end: int) -> Column:
    """Tokens from ``start`` to before ``end``, from 0."""
    return F.slice(tokens_, start + 1, max(0, end - start))


def sub_span_text(tokens_: Column, start: Column, end: Column) -> Column:
    """Tokens from ``start`` to ``end``, both included, joined by spaces."""
    return F.array_join(F.slice(tokens_, start + 1, end - start + 1), " ")


def by_offsets(text: Column, offsets: Column) -> Column:
    """Tokens at given (start, end) offsets, ends exclusive."""
    return F.transform(offsets, lambda o: F.substring(text, o["start"] + 1, o["end"] - o["start"]))


def is_filtered_word(word: Column) -> Column:
    """True for a stop word, or for a word of punctuation alone."""
    return word.rlike(r"^\p{P}+$") | F.lower(word).isin(STOPWORDS)


def drop_ngram(gram: Column, mode: str = "any") -> Column:
    """True where an n-gram is to be dropped."""
    if mode == "any":
        return F.exists(gram, is_filtered_word)
    if mode == "all":
        return F.forall(gram, is_filtered_word)
    if mode == "ends":
        return is_filtered_word(F.get(gram, 0)) | is_filtered_word(F.element_at(gram, -1))
    raise ValueError(f"Invalid mode: {mode}")


def ngrams(tokens_: Column, n: int = 1, uncased: bool = False, mode: str | None = None) -> Column:
    """All n-grams of 1 to ``n`` tokens, by start and then length, joined by spaces.

    Words are judged once each. An n-gram is joined to a string at once: a word that is
    missing, beyond the end or dropped, is null and makes it null, and nulls go.
    """

    def joined(t: Column, first: Column, i: Column, k: int) -> Column:
        return F.concat(first, *[x for j in range(1, k) for x in (F.lit(" "), F.get(t, i + j))])

    def spans(t: Column) -> Column:
        return F.flatten(F.transform(t, lambda w, i: F.array(*[joined(t, w, i, k) for k in range(1, n + 1)])))

    def judged(t: Column, dropped: Column) -> Column:
        def one(w: Column, i: Column, k: int) -> Column:
            ends = F.get(dropped, i) | F.get(dropped, i + (k - 1))
            flag = ends if mode == "ends" else F.forall(F.slice(dropped, i + 1, F.lit(k)), lambda x: x)
            return F.when(~flag, joined(t, w, i, k))

        return F.flatten(F.transform(t, lambda w, i: F.array(*[one(w, i, k) for k in range(1, n + 1)])))

    t = words(tokens_, uncased)
    if mode is None:
        return let(t, lambda t: F.array_compact(spans(t)))
    if mode == "any":
        return let(F.transform(t, lambda w: F.when(~is_filtered_word(w), w)), lambda t: F.array_compact(spans(t)))
    if mode not in ("all", "ends"):
        raise ValueError(f"Invalid mode: {mode}")
    return let(t, lambda t: let(F.transform(t, is_filtered_word), lambda dropped: F.array_compact(judged(t, dropped))))


def trim_all(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), trim_all), lambda p: p != "")


def clean_paragraphs(document: Column) -> Column:
    """Paragraphs of sentences without anchors, empty sentences and empty paragraphs; null if none is left."""
    cleaned = F.transform(document, lambda p: F.filter(F.transform(p, strip_anchors), lambda s: s != ""))
    kept = F.filter(cleaned, lambda p: F.size(p) > 0)
    return let(kept, lambda k: F.when(F.size(k) > 0, k))


def lead_sentences(document: Column, min_chars: int = 500, least: int = 10) -> Column:
    """Sentences of the lead: paragraphs after the first until ``min_chars`` are reached.

    A sentence other than the very first gets a leading space if it has none; spaces
    that are added don't count. Null where fewer than ``least`` characters are found.
    """
    kind = "struct<sentences:array<string>,chars:int,open:boolean>"
    start = F.struct(F.array().alias("sentences"), F.lit(0).alias("chars"), F.lit(True).alias("open")).cast(kind)

    def add(state: Column, paragraph: Column) -> Column:
        own = F.filter(paragraph["s"], lambda s: s["t"] != "")
        spaced = F.transform(
            own,
            lambda s: F.when(
                ~s["t"].startswith(" ") & ((paragraph["i"] > 0) | (s["j"] > 0)), F.concat(F.lit(" "), s["t"])
            ).otherwise(s["t"]),
        )
        chars = state["chars"] + F.aggregate(own, F.lit(0), lambda a, s: a + F.length(s["t"]))
        grown = F.struct(F.concat(state["sentences"], spaced).alias("sentences"), chars.alias("chars"), (chars < min_chars).alias("open"))
        return F.when(state["open"], grown.cast(kind)).otherwise(state)

    rest = F.slice(document, 2, F.greatest(F.lit(0), F.size(document) - 1))
    numbered = F.transform(
        rest,
        lambda p, i: F.struct(
            i.alias("i"), F.transform(p, lambda s, j: F.struct(j.alias("j"), strip_anchors(s).alias("t"))).alias("s")
        ),
    )
    return F.aggregate(numbered, start, add, lambda s: F.when(s["chars"] >= least, s["sentences"]))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, white space collapsed."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    without = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(without, r"(?U)\s+", " "))


def unescape_title(title: Column) -> Column:
    """URL-decoded, underscores as spaces; a plus sign stays, a malformed escape stays."""
    decoded = F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B")))
    return F.translate(F.coalesce(decoded, title), "_", " ")


def paragraph_name(title: Column, number: Column) -> Column:
    return F.concat_ws("_", title, number.cast("string"))


def name_title(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)_[^_]*$", 1)


def name_number(name: Column) -> Column:
    return F.regexp_extract(name, r"_([^_]*)$", 1).cast("int")


def sentence_segments(tokens_: Column) -> Column:
    """Sentence number of each token; a full stop belongs to the sentence that it ends."""
    kind = "struct<n:int,out:array<int>>"
    start = F.struct(F.lit(0).alias("n"), F.array().alias("out")).cast(kind)

    def step(state: Column, token: Column) -> Column:
        n = state["n"] + F.when(token == ".", 1).otherwise(0)
        return F.struct(n.alias("n"), F.concat(state["out"], F.array(state["n"])).alias("out")).cast(kind)

    return F.aggregate(tokens_, start, step, lambda s: s["out"])


def list_segments(sentences: Column) -> Column:
    """Sentence number of each token of a list of tokenised sentences; empty ones don't count."""
    kept = F.filter(sentences, lambda s: F.size(s) > 0)
    return F.flatten(F.transform(kept, lambda s, i: F.array_repeat(i, F.size(s))))


def shift_supporting(sentences: Column, supporting: Column) -> Column:
    """Sentence indexes after empty sentences are left out.

    Each empty sentence moves down the indexes above the number of sentences kept before it.
    """
    kind = "struct<kept:int,ids:array<int>>"
    start = F.struct(F.lit(0).alias("kept"), supporting.alias("ids")).cast(kind)

    def step(state: Column, sentence: Column) -> Column:
        moved = F.transform(state["ids"], lambda i: F.when(i > state["kept"], i - 1).otherwise(i))
        empty = F.struct(state["kept"].alias("kept"), moved.alias("ids")).cast(kind)
        full = F.struct((state["kept"] + 1).alias("kept"), state["ids"].alias("ids")).cast(kind)
        return F.when(F.size(sentence) == 0, empty).otherwise(full)

    return F.aggregate(sentences, start, step, lambda s: s["ids"])


def token_ids(tokens_: Column, begin: int, end: int, lookup) -> Column:
    """Ids between a begin and an end id; ``lookup`` maps a token to its id."""
    return F.concat(F.array(F.lit(begin)), F.transform(tokens_, lookup), F.array(F.lit(end)))


def char_ids(word: Column, length: int = 50, begin: int = 258, end: int = 259, pad: int = 260) -> Column:
    """Byte codes of a word between begin and end codes, cut and padded to ``length``, all moved up by one."""
    raw = F.encode(word, "utf-8")
    hexed = F.hex(raw)
    codes = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(length - 3)), lambda i: i < F.octet_length(word)),
        lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )
    framed = F.concat(F.array(F.lit(begin)), codes, F.array(F.lit(end)))
    padded = F.concat(framed, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(framed))))
    return F.transform(padded, lambda c: c + 1)
