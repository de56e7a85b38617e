"""English stop list for TF-IDF terms.

This is our own list of English function words (articles, pronouns,
auxiliaries, prepositions, conjunctions, common adverbs).  Scores are defined
relative to it; callers pass ``stopwords=`` to use another list.  Only
tokens of two or more characters matter, so one-letter words are omitted.
"""

ENGLISH_STOPWORDS = frozenset("""
about above after again against all almost along already also although always am among an and
another any anyone anything are around as at be became because been before being below between
both but by can cannot could did do does doing done down during each either else enough even ever
every few for from further had has have having he her here hers herself him himself his how however
if in into is it its itself just least less many may me might more most much must my myself neither
never no nor not now of off often on once one only onto or other others otherwise our ours ourselves
out over own per perhaps rather same several she should since so some still such than that the their
theirs them themselves then there therefore these they this those though through thus to together too
toward under until up upon us very via was we well were what whatever when whenever where whereas
wherever whether which while who whoever whom whose why will with within without would yet you your
yours yourself yourselves
""".split())
