"""Settings of the engine. Every choice that changes a result is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds, weights and windows of candidate resolution. Defaults are fixed values."""

    close_similarity: float = 0.7
    near_similarity: float = 0.9
    exact_similarity: float = 0.99
    exact_weight: int = 50
    near_weight: int = 20
    affiliation_weight: int = 20
    years_before: int | None = None  # no lower bound
    years_after: int = 1
    affiliation_tolerance: int = -4
    country: str = "NL"
    max_contributors: int = 10
    max_candidates: int | None = None
    ignore_null_doi: bool = True
    thesis_id_mode: str = "work_id"  # or "legacy": never a coauthor
    confirm_rule: str = "shared_affiliation"  # or "shared_publication", "same_grad_institution"
    confirm_text: str = "Shared affiliation at graduation."


@dataclass(frozen=True)
class CleanConfig:
    """Years, sample sizes and seeds of cleaning. Defaults are fixed values."""

    first_year: int = 2011
    last_year: int = 2022
    sample_rows: int = 500
    sample_seed: int = 12
    replacement_seed: int = 13
    subset_seed: int = 42
    accept_ambiguous: bool = False
    strict_initials: bool = False
    rank_by: str = "row_id"


@dataclass(frozen=True)
class WordLists:
    """Words that tell organisations from persons. They are data: pass your own lists for your corpus.

    The defaults are a small general selection, by kind and language. Words are compared in lower case.
    """

    #: Whole words of organisations: bodies and units, then the same in other languages.
    words: tuple[str, ...] = (
        "academy", "agency", "association", "authority", "bank", "board", "center", "centre", "college", "commission", "committee", "company", "consortium", "corporation", "council", "department", "faculty",
        "foundation", "group", "hospital", "institute", "laboratory", "library", "ministry", "museum", "network", "observatory", "organisation", "organization", "school", "society", "trust", "university",
        "hochschule", "universität", "klinikum", "verein", "gesellschaft", "université", "laboratoire", "école", "universidad", "facultad", "escuela", "università", "universiteit", "hogeschool", "ziekenhuis", "stichting",
    )
    #: What only the start of an organisation's name has.
    prefixes: tuple[str, ...] = ("department of ", "faculty of ", "institute of ", "institute for ", "school of ", "college of ", "university of ", "ministry of ", "museum of ", "office of ", "centre for ", "center for ")
    #: Endings of fields of study and of bodies.
    endings: tuple[str, ...] = ("ology", "ography", "onomics", "matics", "sciences", "chemistry", "physics", "engineering", "wissenschaft", "wissenschaften", "institut", "stiftung")
    #: What stands before a last name and belongs to it: Dutch, German, French, Italian, Spanish and Portuguese, Arabic.
    particles: tuple[str, ...] = ("van", "de", "der", "den", "het", "ten", "ter", "von", "vom", "zu", "zum", "zur", "du", "des", "le", "la", "les", "di", "da", "dal", "della", "del", "dos", "el", "al", "bin", "ibn", "abu")
    titles: tuple[str, ...] = ("mr", "mrs", "ms", "miss", "sir", "dame", "dr", "doctor", "prof", "professor", "emeritus", "emerita", "rev", "hon", "herr", "frau", "ir", "ing", "drs")
    suffixes: tuple[str, ...] = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "dphil", "msc", "bsc", "mba", "esq")
    institutions: dict[str, str] = field(default_factory=dict, hash=False)
