"""Fixed values and thresholds of the corpus operators.

Word lists, patterns and thresholds are those the results depend on; they are
data, not logic.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- quality ---------------------------------------------------------------

MIN_TEXT_CHARS, SHORT_TEXT_CHARS, LONG_TEXT_CHARS, MAX_TEXT_CHARS = 500, 1000, 50000, 100000
MIN_WORDS = 100
ACCEPT_SCORE, DATASET_SCORE = 0.1, 0.3
WEIGHTS = {"length": 0.15, "readability": 0.25, "structure": 0.25, "completeness": 0.20, "language": 0.15}

COMMON_WORDS = (
    "the and of to a in is it you that he was for on are as with his they i at be this have from or one had by word "
    "but what some we can out other were all there when up use your how said each which their time will about if many "
    "then them these so her would make like into him has two more very know just first get over think also do"
).split()
ARTICLES = "a an the".split()
PREPOSITIONS = (
    "in on at by for with without through during before after above below up down out off over under again further then once"
).split()
METHOD_TERMS = (
    "method approach algorithm technique framework model system analysis evaluation experiment study research data results "
    "findings conclusion abstract introduction"
).split()
RESEARCH_VERBS = (
    "propose present demonstrate show prove analyze evaluate compare investigate explore examine study develop implement design"
).split()
ACADEMIC_PHRASES = r"et al\.|i\.e\.|e\.g\.|cf\.|viz\.|ibid\.|op\. cit\."
TRUNCATION_MARKS = ("...", "[truncated]", "[continued]", "see full text", "download full paper")
KEY_SECTIONS = ("abstract", "introduction", "methodology", "results", "conclusion")
CRITICAL_ISSUES = ("empty_text", "likely_non_english", "excessive_special_chars", "likely_incomplete")
ADVICE = {
    "length": "Consider if text extraction was complete",
    "readability": "Check for encoding or language issues",
    "structure": "Verify academic paper structure",
    "completeness": "Check for text truncation",
}
TARGET_CATEGORIES = ("cs.AI", "cs.CL", "cs.LG", "cs.CV", "cs.IR", "cs.NE", "cs.ML", "cs.IT", "stat.ML")
RELATED_CATEGORIES = ("cs.HC", "cs.IT", "cs.SD", "cs.SI", "stat.ML", "cs.DB", "cs.RO", "cs.CC", "cs.DC", "cs.DS", "cs.PL")

# --- cleaning --------------------------------------------------------------

#: One character to one character, after compatibility normalisation.
SAME_LENGTH = {"´": "'", "`": "'", "’": "'", "‘": "'", "”": '"', "“": '"', "–": "-", "—": "-", "¯": "-", "¨": ""}
#: One character to several, in this order.
LONGER = {
    "…": "...", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu",
    "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi",
    "≤": "<= ", "≥": ">= ", "≠": "!= ", "≈": "~= ", "∞": "infinity",
}
SIMPLE_HEADERS = (
    "abstract", "introduction", "related work", "methodology", "method", "approach", "experiments", "results", "evaluation",
    "discussion", "conclusion", "conclusions", "references", "bibliography", "acknowledgments", "acknowledgements", "appendix",
)

# --- sections --------------------------------------------------------------


@dataclass(frozen=True)
class SectionRule:
    name: str
    titles: str  # alternation of what a header line may say
    position: float  # where in a paper it is expected
    min_words: int
    max_words: int
    numbered: str | None = None  # the titles that may follow a number, if not all


SECTION_RULES = (
    SectionRule("abstract", "abstract", 0.0, 50, 500),
    SectionRule("introduction", "introduction", 0.1, 100, 2000),
    SectionRule("related_work", r"related\s+works?|background|literature\s+review", 0.2, 100, 2000, r"related\s+works?|background"),
    SectionRule("methodology", "methodology|methods?|approach|model", 0.3, 200, 3000, "methodology|methods?|approach"),
    SectionRule("experiments", r"experiments?|experimental\s+setup|evaluation", 0.5, 200, 3000, "experiments?|evaluation"),
    SectionRule("results", r"results?|results?\s+and\s+discussion", 0.6, 100, 2500),
    SectionRule("discussion", "discussion|analysis", 0.7, 100, 2000),
    SectionRule("conclusion", r"conclusions?|concluding\s+remarks", 0.8, 50, 1000),
    SectionRule("references", "references?|bibliography", 0.9, 10, 5000),
    SectionRule("acknowledgments", "acknowledgments?|acknowledgements?", 0.85, 10, 500),
    SectionRule("appendix", r"appendix|appendices|appendix\s+[a-z]", 0.95, 50, 10000, "appendix"),
)
SECTION_ORDER = (
    "abstract", "introduction", "related_work", "methodology", "experiments", "results", "discussion", "conclusion",
    "acknowledgments", "references", "appendix", "body", "introduction_unlabeled",
)
CHUNK_CHARS = 1000
CHUNK_BATCH = 1000
CHUNK_CONFIDENCE = 0.8

# --- citations -------------------------------------------------------------

JOURNAL_WORDS = "journal transactions proceedings review letters ieee acm nature science cell lancet".split()
CONFERENCE_WORDS = (
    "conference workshop symposium meeting icml neurips nips iclr aaai ijcai acl emnlp cvpr iccv eccv sigir www chi"
).split()

# --- topics and reports ------------------------------------------------------

#: Words that say nothing about a paper's topic.
DOMAIN_STOP_WORDS = (
    "paper study research method approach result conclusion introduction abstract figure table section chapter authors "
    "references citation arxiv preprint published journal conference algorithm performance evaluation experiment dataset "
    "data model models modeling framework"
).split()
#: The advice of a report.
CLASSIFIER_ADVICE = {
    "weak": "Classification: Consider data augmentation or feature engineering",
    "imbalanced": "Classification: Address class imbalance with sampling techniques",
    "fine": "Classification: Performance is satisfactory",
}
CLUSTER_ADVICE = {"weak": "Clustering: Consider different features or preprocessing", "fine": "Clustering: Good cluster separation achieved"}
LEAST_ACCURACY, LEAST_SILHOUETTE = 0.8, 0.3
