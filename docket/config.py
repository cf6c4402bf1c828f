"""Run configuration and the term lexicon used by the rule analyzer.

Both are frozen dataclasses passed as arguments; nothing is read from the
process environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from docket.functions.captions import FULL as FULL_CITATION


@dataclass(frozen=True)
class Lexicon:
    """Terms and patterns that drive :class:`docket.operators.analyze.RuleAnalyzer`.

    Every term is matched on lower-cased text as a whole word or phrase: the
    characters either side must not be ``a``-``z`` (or be the text edge).
    """

    # Candidate phrases (E10): a document is a candidate when it contains one.
    candidate_phrases: tuple[str, ...] = ("intentional spoliation", "impairment of a civil claim")
    # Topic terms: a sentence "mentions the topic" when it has one.
    topic_terms: tuple[str, ...] = ("spoliation", "impairment of a civil claim")
    # Holding terms: a topic sentence that also has one "addresses the holding" (E03 High).
    holding_terms: tuple[str, ...] = ("standalone tort", "independent tort", "cause of action")
    # Support and contra terms: net hits decide the support level.
    support_terms: tuple[str, ...] = (
        "duplicative recovery",
        "existing remedies",
        "adequate remedies",
        "not recognize",
        "declined to recognize",
    )
    contra_terms: tuple[str, ...] = ("recognized the tort", "we recognize", "is a tort")
    # Opinions decided before this year "predate" the anchor decision.
    anchor_year: int = 2015
    # Blue Book case citation: any known reporter, docket and database numbers, parallel reporters.
    citation_pattern: str = FULL_CITATION
    # A case without a citation line is named by its header block (court, docket, parties, date).
    case_headers: bool = True
    # Quote delimiters for E07; straight quotes: ('"', '"'), which keep to one line.
    quote_open: str = "“"
    quote_close: str = "”"
    summary_sentences: int = 3
    # Argument lead-ins per support level.
    position: str = "that intentional spoliation is not a standalone tort"
    lead_strong: str = "strongly supports the position"
    lead_support: str = "supports the position"
    lead_against: str = "is distinguishable from the position"

    def with_terms(self, **kw) -> "Lexicon":
        return replace(self, **kw)


# Lexicon for the driver fixtures: their words are invented, so the legal terms never
# hit. These values are fixed by FIXTURES.md section 4 and the expected counts there.
FIXTURE_LEXICON = Lexicon(
    candidate_phrases=("thtion", "worthless"),
    topic_terms=("thtion", "worthless"),
    holding_terms=("thble", "ertion"),
    support_terms=("thing", "erble", "ering"),
    contra_terms=("attion", "oning"),
    anchor_year=2015,
    case_headers=False,
    citation_pattern=(
        r"[A-Z][A-Za-z0-9]* v\. [A-Z][A-Za-z0-9]*, [0-9]+ So\. [23]d [0-9]+ \(La\. [0-9]{4}\)"
    ),
)

# The default terms over texts without real citations.
LEGAL_LEXICON = Lexicon().with_terms(case_headers=False, citation_pattern=FIXTURE_LEXICON.citation_pattern)


@dataclass(frozen=True)
class Config:
    """Inference and routing settings (defaults follow the original tool's defaults)."""

    model_name: str = "o1"
    # Requests per exported batch (R08); the original tool also used it as its concurrency.
    max_concurrent_requests: int = 10
    max_retries: int = 1
    retry_delay_s: float = 1.0
    # Concurrency of one inference task; cluster-wide ceiling = running tasks x threads.
    threads_per_task: int = 8
    # Partitions for the inference stage (None: one per ``requests_per_task`` requests,
    # at least the default parallelism). Small tasks bound the calls a lost executor repeats.
    inference_partitions: int | None = None
    requests_per_task: int = 500
    # Tasks of one wave of the work queue: a job never plans more, whatever the number of requests,
    # and a run that is killed repeats at most its last wave.
    tasks_per_wave: int = 10_000
    # The response store has 16 ** digits buckets of request keys; a store keeps the number it was begun with.
    store_digits: int = 2
    # Rows per Arrow batch handed to Python (large texts: keep it small).
    arrow_batch_rows: int = 64
    template_id: str = "default-v1"
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __post_init__(self):
        if self.max_retries < 0:
            raise ValueError("max_retries must be >= 0")
        if self.retry_delay_s < 0:
            raise ValueError("retry_delay_s must be >= 0")
        if min(self.max_concurrent_requests, self.threads_per_task, self.requests_per_task, self.tasks_per_wave) < 1:
            raise ValueError("concurrency settings must be >= 1")
        if not 1 <= self.store_digits <= 4:
            raise ValueError("store_digits must be from 1 to 4")

    @property
    def retry_delay_ms(self) -> int:
        return int(round(self.retry_delay_s * 1000))
