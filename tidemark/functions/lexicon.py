"""Fixed word lists."""

from __future__ import annotations

# The English stop words of Spark's own StopWordsRemover.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's "
    "we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't "
    "mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would"
).split()

# Words left out of top lists and of phrase comparisons.
TOP_WORDS_LEFT_OUT = "god jesus christ lord father spirit".split()
PHRASE_WORDS_LEFT_OUT = (
    "said would may shall must can could will also one two three make made like get go know think see come even well back much good many first last "
    "long little own other old right new way day time year work part place"
).split()

# Abbreviations whose full stop doesn't end a sentence, titles and honorifics.
ABBREVIATIONS = "mr mrs ms dr st jr sr vs no vol pp etc".split()
TITLES = "president elder sister brother bishop presidents elders".split()
HONORIFICS = "mr mrs ms dr".split()

# Words that are no names though they are capitalised, and how such words may begin.
PROPER_ALLOWED = "familysearch justserve covid seminary primary".split()
PROPER_ALLOWED_START = "christ"

# Inflections that the dictionary accepts, as (suffix, what stands for it).
INFLECTIONS = (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("d", ""), ("ly", ""), ("er", ""), ("ers", ""))


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
