"""The rule catalogue: what counts as personal data or a secret, and in which profile.

A rule is one regular expression plus the label its placeholder carries.  The
built-in expressions stay inside the subset that Java and RE2 read alike (no
lookaround, no back-references), and none of them can match a line break, so a
text may be cut into lines without changing what is found.  Groups are repeated a
limited number of times: Java's matcher goes one call deeper with each repeat, and an
endless one in a hostile text would end the executor.

``hints`` and ``gate`` only save time.  They state something every matching
text also satisfies, so a text that fails them can skip the full expression.
``family`` does the same for a group of rules at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Profile names.
PROFILES = (
    "general", "dev", "medical", "pharma", "legal", "compliance", "ccpa",
    "finance", "bizops", "sales", "wealthmgmt", "insurance", "accounting",
    "hr", "security", "marketing", "support", "realestate", "agents",
    "academic", "creative", "tech", "personal",
)

# The five secret detectors, in reporting order.
SECRET_DETECTORS = (
    ("AWS Credentials",
     r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA)[A-Z0-9]{16}\b"),
    ("JSON Web Token (JWT)",
     r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b"),
    ("API Token/Key (GitHub/Slack/NPM)",
     r"\b(?:ghp|gho|ghu|ghs|ghr|glpat|npm|xox[baprs])[-_][A-Za-z0-9_]{10,}\b"),
    ("Stripe API Key",
     r"\b(?:[rs]k)_(?:test|live)_[a-zA-Z0-9]{24,}\b"),
    ("Database/API Secret",
     r"(?i)\b(DB|POSTGRES|REDIS|MYSQL|AWS|SECRET|PASSWORD|TOKEN|API|KEY)"
     r"[A-Z0-9_]*\s*[:=]\s*[^ \t\r\n\"']{8,}\b"),
)

# URL schemes whose accidental doubling is undone on reveal.
DOUBLED_SCHEMES = (
    "mysql", "postgresql", "postgres", "redis", "mongodb", "http", "https",
    "ftp", "ssh", "git", "aws",
)

# What a new rule file starts with.
TEMPLATE_RULE = {"pattern": r"my-secret-pattern-\d+", "label": "CUSTOM_TAG"}
TEMPLATE_EXCLUSIONS = (
    "localhost", "127.0.0.1", "0.0.0.0", "process.env", "PORT",
    "node_modules", "console.log", "console.error", "utf-8", "utf8",
)

# Limits.
MAX_TEXT_CHARS = 50_000
MAX_FILE_BYTES = 10 * 1024 * 1024
BINARY_SNIFF_BYTES = 8_000
# ---------------------------------------------------------------------------

# Given names that start a person name.  Extend with ``name_rule(more_names)``.
GIVEN_NAMES = (
    "Adam", "Alan", "Albert", "Alex", "Alexander", "Alice", "Amanda", "Amy",
    "Andrea", "Andrew", "Angela", "Anna", "Anne", "Anthony", "Barbara",
    "Benjamin", "Bob", "Brian", "Carlos", "Carol", "Catherine", "Charles",
    "Christine", "Christopher", "Claire", "Daniel", "David", "Deborah",
    "Diana", "Donald", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily",
    "Emma", "Eric", "Eva", "Frank", "Gary", "George", "Grace", "Hannah",
    "Helen", "Henry", "Isabel", "Jack", "Jacob", "James", "Jane", "Jason",
    "Jean", "Jennifer", "Jessica", "Joan", "John", "Jonathan", "Jose",
    "Joseph", "Joshua", "Juan", "Julia", "Karen", "Katherine", "Kevin",
    "Laura", "Linda", "Lisa", "Louis", "Lucas", "Lucy", "Margaret", "Maria",
    "Marie", "Mark", "Martin", "Mary", "Matthew", "Michael", "Michelle",
    "Nancy", "Nicole", "Oliver", "Olivia", "Pamela", "Patricia", "Patrick",
    "Paul", "Peter", "Philip", "Rachel", "Rebecca", "Richard", "Robert",
    "Ruth", "Samuel", "Sandra", "Sara", "Sarah", "Scott", "Sharon", "Simon",
    "Sophia", "Stephen", "Steven", "Susan", "Thomas", "Timothy", "Victoria",
    "William",
)

# Places the general profile masks.  Longer lists go through ``detect_places``.
PLACES = (
    "Amsterdam", "Athens", "Atlanta", "Barcelona", "Beijing", "Berlin",
    "Boston", "Brussels", "Budapest", "Cairo", "Chicago", "Copenhagen",
    "Dallas", "Delhi", "Denver", "Dublin", "Frankfurt", "Geneva", "Hamburg",
    "Helsinki", "Hong Kong", "Houston", "Istanbul", "Jakarta", "Johannesburg",
    "Lagos", "Lisbon", "London", "Los Angeles", "Madrid", "Melbourne",
    "Mexico City", "Miami", "Milan", "Montreal", "Moscow", "Mumbai", "Munich",
    "Nairobi", "New York", "Oslo", "Paris", "Philadelphia", "Prague", "Rome",
    "San Francisco", "Santiago", "Seattle", "Seoul", "Shanghai", "Singapore",
    "Stockholm", "Sydney", "Tokyo", "Toronto", "Vancouver", "Vienna",
    "Warsaw", "Washington", "Zurich",
)


# Labels that a placeholder can carry and be read back from; their length is kept in three digits.
MAX_LABEL_CHARS = 100


def valid_label(label: str) -> bool:
    """Whether ``[LABEL_1]`` can be told from the text around it."""
    return len(label) <= MAX_LABEL_CHARS and re.fullmatch(r"[^\[\] \t\r\n]+", label) is not None


@dataclass(frozen=True)
class Rule:
    """One detection rule.  A lower ``priority`` wins when findings overlap."""

    rule_id: str
    entity_type: str
    pattern: str
    priority: int
    profile: str = "general"
    hints: tuple[str, ...] = ()
    gate: str | None = None
    family: str | None = None
    line_local: bool = True
    enabled: bool = True

    def __post_init__(self) -> None:
        if not valid_label(self.entity_type):
            raise ValueError(f"a placeholder cannot carry the label {self.entity_type!r}")


# Every rule about digits needs at least this.
DIGITS = r"\d[\d.]"


def _words(values: tuple[str, ...]) -> str:
    return "|".join(values)


def _by_initial(words: tuple[str, ...]) -> str:
    """An alternation grouped by first letter: fewer comparisons where nothing matches."""
    initials = sorted({w[0] for w in words})
    groups = (_words(tuple(sorted(w[1:] for w in words if w[0] == c))) for c in initials)
    return "|".join(f"{c}(?:{g})" for c, g in zip(initials, groups))


def _capitalised(words: tuple[str, ...]) -> str:
    """A fast test for texts that may hold one of some capitalised words.

    Any capital followed by the rest of any word passes; the rests are grouped
    by their first letter, so that most capitals fail after one comparison.
    """
    rests = sorted({w[1:] for w in words})
    seconds = sorted({r[0] for r in rests})
    groups = (_words(tuple(r[1:] for r in rests if r[0] == c)) for c in seconds)
    return "[A-Z](?:" + "|".join(f"{c}(?:{g})" for c, g in zip(seconds, groups)) + ")"


# The test shared by the default name and place rules: one pass over the text for both.
CAPITALISED = _capitalised(GIVEN_NAMES + PLACES)


def name_rule(given_names=GIVEN_NAMES, priority: int = 3_060) -> Rule:
    """Person names: a known given name followed by one capitalised word."""
    words = _by_initial(tuple(given_names))
    return Rule(
        "name", "NAME", rf"\b(?:{words}) [A-Z][a-z]+\b", priority,
        gate=_capitalised(tuple(given_names)) + " [A-Z][a-z]",
        family=CAPITALISED if set(given_names) <= set(GIVEN_NAMES) else None,
    )


def location_rule(places=PLACES, priority: int = 3_070) -> Rule:
    """Places from a short list."""
    words = _by_initial(tuple(places))
    return Rule(
        "location", "LOCATION", rf"\b(?:{words})\b", priority,
        gate=_capitalised(tuple(places)),
        family=CAPITALISED if set(places) <= set(PLACES) else None,
    )


# Four of the detectors also mask what they find; the fifth has a form of its own below that takes in the quotes.
_DETECTOR_PATTERNS = dict(SECRET_DETECTORS)

_SECRETS = (
    *(
        Rule(rule_id, "SECRET", _DETECTOR_PATTERNS[name], priority, **tests)
        for rule_id, name, priority, tests in (
            ("secret_cloud", "AWS Credentials", 2_000, {"gate": r"A(?:KI|SI|GP|ID|RO|IP)A[A-Z0-9]"}),
            ("secret_jwt", "JSON Web Token (JWT)", 2_010, {"hints": ("eyJ",)}),
            ("secret_vendor", "API Token/Key (GitHub/Slack/NPM)", 2_020, {"gate": r"[-_]\w{10}"}),
            ("secret_stripe", "Stripe API Key", 2_030, {"hints": ("k_test_", "k_live_")}),
        )
    ),
    Rule("secret_sk", "SECRET", r"\bsk-[A-Za-z0-9-]{8,}\b", 2_040, hints=("sk-",)),
    Rule("secret_dev", "SECRET", r"\bdev-key-\w+\b", 2_050, hints=("dev-key-",)),
    Rule("secret_kv", "SECRET",
         r"(?i)\b(?:DB|POSTGRES|REDIS|MYSQL|AWS|SECRET|PASSWORD|TOKEN|API|KEY)[A-Z0-9_]*"
         r"[ \t]*[:=][ \t]*[\"']?[^ \t\r\n\"']{8,}[\"']?", 2_060,
         hints=("=", ":"), gate=r"[:=][ \t]*[\"']?[^ \t\r\n\"']{8}"),
    Rule("secret_kv_spaced", "SECRET",
         r"(?i)\b(?:API|SECRET|ACCESS|PRIVATE)[ _-](?:KEY|TOKEN)[ \t]*[:=][ \t]*[\"']?[^ \t\r\n\"']{8,}[\"']?",
         2_055, hints=("=", ":"), gate=r"[:=][ \t]*[\"']?[^ \t\r\n\"']{8}"),
)

_BASE = (
    Rule("email", "EMAIL", r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}", 3_000,
         hints=("@",), gate=r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]"),
    Rule("id", "ID", r"\b\d{3}-\d{2}-\d{4}\b", 3_010, gate=r"\d-\d\d-\d", family=DIGITS),
    Rule("card", "CARD", r"\b(?:\d{4}[- ]?){3}\d{4}\b", 3_020, gate=r"\d{4}[- ]?\d{4}", family=DIGITS),
    Rule("ip", "IP",
         r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 3_030, 
         gate=r"\d\.\d", family=DIGITS),
    Rule("phone", "PHONE",
         r"(?:\+\d{1,3}[-. ])?(?:\(\d{3}\)|\b\d{3})[-. ]\d{3}[-. ]\d{4}\b|\b\d{3}-\d{4}\b", 3_040,
         gate=r"\d{3}[-. )]{1,2}\d{3}", family=DIGITS),
)

# (profile, entity_type, pattern, hints): the industry packs, in priority order.
_PACKS = (
    ("dev", "CREDENTIAL", r"\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s]+@[^\s/:@]+", ("://",)),
    ("medical", "MRN", r"\bMRN-\d+\b", ("MRN-",)),
    ("medical", "NPI", r"\bNPI:? ?\d{10}\b", ("NPI",)),
    ("pharma", "SUBJECT", r"\bSUBJ-?\d+\b", ("SUBJ",)),
    ("pharma", "PROTOCOL", r"\bIND-\d+\b", ("IND-",)),
    ("pharma", "LOT", r"\bLOT-\d+\b", ("LOT-",)),
    ("legal", "CASE", r"\bCASE-\d+\b", ("CASE-",)),
    ("legal", "DOCKET", r"\bCV-\d{2}-\d+\b", ("CV-",)),
    ("compliance", "AUDIT", r"\bGDPR-AUDIT-\d{4}\b", ("GDPR-AUDIT-",)),
    ("compliance", "DSAR", r"\bDSAR-\d+\b", ("DSAR-",)),
    ("ccpa", "LICENSE", r"\bDL-\d+\b", ("DL-",)),
    ("ccpa", "ACCOUNT", r"\bACC\d+\b", ("ACC",)),
    ("finance", "PORTFOLIO", r"\bPORTFOLIO-\d+\b", ("PORTFOLIO-",)),
    ("bizops", "DEAL", r"\bDEAL-\d+\b", ("DEAL-",)),
    ("bizops", "NDA", r"\bNDA-\d+\b", ("NDA-",)),
    ("sales", "OPPORTUNITY", r"\bOPPORTUNITY-\d+\b", ("OPPORTUNITY-",)),
    ("sales", "MONEY", r"\$\d+(?:[,.]\d+){0,100}[KMB]?", ("$",)),
    ("wealthmgmt", "ROUTING", r"\b[Rr]outing:? ?\d{9}\b", ("outing",)),
    ("wealthmgmt", "MONEY", r"\$\d+(?:[,.]\d+){0,100}[KMB]?", ("$",)),
    ("insurance", "POLICY", r"\bPOL-?\d+\b", ("POL",)),
    ("insurance", "VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", ()),
    ("accounting", "EIN", r"\b\d{2}-\d{7}\b", ()),
    ("accounting", "MONEY", r"\$\d+(?:[,.]\d+){0,100}[KMB]?", ("$",)),
    ("hr", "EEID", r"\bEEID:? ?\d+\b", ("EEID",)),
    ("hr", "DOB", r"\b\d{1,2}/\d{1,2}/\d{4}\b", ("/",)),
    ("security", "CVE", r"\bCVE-\d{4}-\d{4,}\b", ("CVE-",)),
    ("marketing", "LEAD", r"\bLEAD-\d+\b", ("LEAD-",)),
    ("marketing", "CAMPAIGN", r"\bCAMPAIGN-\d+\b", ("CAMPAIGN-",)),
    ("support", "TICKET", r"\bTICKET-\d+\b", ("TICKET-",)),
    ("support", "ZENDESK", r"\bZENDESK-\d+\b", ("ZENDESK-",)),
    ("realestate", "MLS", r"\bMLS:? ?#?\d+\b", ("MLS",)),
    ("realestate", "GATE_CODE", r"(?i)\bgate code:? ?\d+\b", ()),
    ("agents", "VECTOR", r"\bVECTOR-\d+\b", ("VECTOR-",)),
    ("academic", "STUDENT", r"\bSTUDENT-\d+\b", ("STUDENT-",)),
    ("academic", "FERPA", r"\bFERPA-\d+\b", ("FERPA-",)),
    ("creative", "DRAFT", r"\bDRAFT-\d+\b", ("DRAFT-",)),
    ("creative", "EMBARGO", r"\bEMBARGOED\b", ("EMBARGOED",)),
    ("tech", "INSTANCE", r"\bINSTANCE-ID-[a-z0-9]+\b", ("INSTANCE-ID-",)),
    ("tech", "KUBECONFIG", r"\bKUBECONFIG-\w+\b", ("KUBECONFIG-",)),
    ("personal", "PASSWORD", r"(?i)\bpassword:? ?[^\s.]+", ()),
)


def base_rules() -> list[Rule]:
    """The rules every profile keeps on: secrets first, then personal data."""
    return [*_SECRETS, *_BASE, name_rule(), location_rule()]


def pack_rules(profile: str) -> list[Rule]:
    """The rules one industry profile adds to the base."""
    pack = [row for row in _PACKS if row[0] == profile]
    return [
        Rule(f"{profile}_{label.lower()}", label, pattern, 1_000 + 10 * i, profile=profile, hints=hints)
        for i, (_, label, pattern, hints) in enumerate(pack)
    ]


def normalise_profile(profile: str | None) -> str:
    """Trim and lower-case a profile name; no name means ``general``."""
    name = "general" if profile is None else profile.strip().lower()
    if name not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; expected one of {', '.join(PROFILES)}")
    return name


def rules_for(profile: str | None = "general", custom: list[Rule] | tuple[Rule, ...] = ()) -> list[Rule]:
    """All enabled rules for ``profile``, in priority order: custom, pack, secrets, base."""
    rules = [*custom, *pack_rules(normalise_profile(profile)), *base_rules()]
    return sorted((r for r in rules if r.enabled), key=lambda r: r.priority)


def chosen_rules(rules: Sequence[Rule] | None, profile: str | None = "general") -> list[Rule]:
    """The given rules, an empty list meaning none at all; without any, those of the profile."""
    if rules is None:
        return rules_for(profile)
    if profile is not None and normalise_profile(profile) != "general":
        raise ValueError("give either rules or a profile")
    return list(rules)
