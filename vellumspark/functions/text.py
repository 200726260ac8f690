"""Tokenisation and per-text statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of Spark's StopWordsRemover.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

#: A word of letters, digits and underscores, or one mark.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: A word of two characters or more.
LONG_WORD = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """The lower-case runs between white space, in order, with repeats; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Lower-case words and single marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_OR_MARK), F.lit(0))


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_WORD), F.lit(0))


def without_stop_words(ts: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(ts, lambda t: ~t.isin(stop))


def mean_length(ts: Column) -> Column:
    total = F.aggregate(ts, F.lit(0).cast("long"), lambda acc, t: acc + F.length(t))
    return F.when(F.size(ts) > 0, total / F.size(ts)).otherwise(0.0)


def richness(ts: Column) -> Column:
    return F.when(F.size(ts) > 0, F.size(F.array_distinct(ts)) / F.size(ts)).otherwise(0.0)
