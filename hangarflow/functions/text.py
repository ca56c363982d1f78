"""Tokens and n-grams as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Spark's English stop words that can match a token ----------
ENGLISH_STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very can will just don should now
cannot could ought would
""".split()
# --- end of fixed values --------------------------------------------------------

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# All white-space characters, as a set for trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "    　"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-case word tokens of two or more characters, stop words removed."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stop_words = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def ngrams(own: Column, following: Column | None = None) -> Column:
    """All 1-, 2- and 3-grams that start in ``own``.

    ``following`` holds up to two tokens that come after ``own`` in the same
    running text; n-grams may reach into it.
    """
    # Bind the token array to a lambda variable: it is used many times.
    if following is None:
        bound = F.array(F.struct(own.alias("own"), own.alias("ext")))
    else:
        bound = F.array(F.struct(own.alias("own"), F.concat(own, following).alias("ext")))

    def build(x: Column) -> Column:
        ext, n_own, n_ext = x["ext"], F.size(x["own"]), F.size(x["ext"])

        def take(start: int, count: Column) -> Column:
            return F.slice(ext, start, F.greatest(F.lit(0), count))

        pairs = F.least(n_own, n_ext - 1)
        triples = F.least(n_own, n_ext - 2)
        bigrams = F.zip_with(
            take(1, pairs), take(2, pairs), lambda a, b: F.concat(a, F.lit(" "), b)
        )

        def grown(two: Column) -> Column:
            # The first two words of a trigram are the bigram at its place.
            starts = F.slice(two, 1, F.greatest(F.lit(0), triples))
            trigrams = F.zip_with(starts, take(3, triples), lambda ab, c: F.concat(ab, F.lit(" "), c))
            return F.concat(x["own"], two, trigrams)

        return F.element_at(F.transform(F.array(bigrams), grown), 1)

    return F.element_at(F.transform(bound, build), 1)
