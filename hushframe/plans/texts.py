"""Text columns built from key columns, spelled so that Spark SQL and DuckDB read them alike.

The generated tables hold few personal data, so queries about a profile or a
secret put numbers from the table's own keys into sample sentences.
"""

from __future__ import annotations

import re


def sentence(template: str, key: str) -> str:
    """SQL text for ``template``; ``{n}`` is the key, left-padded with ones (or cut) to n digits."""
    parts = []
    for piece in re.split(r"(\{\d+\})", template):
        if re.fullmatch(r"\{\d+\}", piece):
            parts.append(f"lpad(CAST({key} AS STRING), {piece[1:-1]}, '1')")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


# One note per profile: what its pack should find, then look-alikes that it should leave.
PROFILE_SENTENCES = {
    "general": "Desk in Lisbon: Ruth Novak, ref 219-{2}-{4}, r{5}@post.example or 415-{4}; not 1219-{2}-{4}, nor Lisbonne.",
    "dev": "Pull from amqp://svc{3}:hunter{4}@mq.example.org then retry sk-batch-{12}; not sk-{2}, nor amqp://svc{3}@mq.",
    "medical": "Chart MRN-{7} and MRN-{3}, signed NPI {10}; not MRN{7}, nor NPI {5}.",
    "pharma": "Arm B: SUBJ-{5} under IND-{6} from LOT-{5}; not SUBJECT{5}, nor PLOT-{5}.",
    "legal": "Filed as CASE-{6}, docket CV-{2}-{5}; not CASE {6}, nor CVS-{2}-{5}.",
    "compliance": "Closed GDPR-AUDIT-{4} after DSAR-{6}; not GDPR-AUDIT-{2}x, nor DSAR {6}.",
    "ccpa": "Holder DL-{8} pays from ACC{9}; not ADL-{8}, nor ACCT{9}.",
    "finance": "Move 5500-{4}-{4}-{4} into PORTFOLIO-{7}; not PORTFOLIO {7}.",
    "bizops": "Stage two of DEAL-{5} waits for NDA-{5}; not IDEAL-{5}, nor NDA {5}.",
    "sales": "Forecast for OPPORTUNITY-{6} is ${4}.{1}M or ${5}; not USD {5}, nor OPPORTUNITY_{6}.",
    "wealthmgmt": "Wire by routing {9}, about ${3}K; not routing {5}, nor {3}K.",
    "insurance": "Loss under POL-{6} on 2HGFG{5}ABCDEFG; not POLE{6}, nor 2HGFG{5}.",
    "accounting": "Return of {2}-{7} shows ${6},{2}; not {3}-{7}x.",
    "hr": "Row EEID:{6} born {1}/{2}/19{2}; not EEID-{6}, nor {1}/{2}.",
    "security": "Patch CVE-20{2}-{5} on 192.0.2.{2}; not CVE-{2}-{5}, nor 192.0.2.",
    "marketing": "From LEAD-{6} in CAMPAIGN-{8}; not MISLEAD-{6}, nor CAMPAIGN {8}.",
    "support": "Merge TICKET-{6} into ZENDESK-{6}; not TICKETS-{6}, nor ZENDESK {6}.",
    "realestate": "Listing MLS#{7}, gate code: {4}; not XMLS {7}, nor gate {4}.",
    "agents": "Nearest to VECTOR-{9}; not EIGENVECTOR-{9}, nor VECTOR {9}.",
    "academic": "Release for STUDENT-{6} under FERPA-{4}; not STUDENTS-{6}, nor FERPA {4}.",
    "creative": "Cut DRAFT-{5} stays EMBARGOED; not DRAFTS-{5}, nor embargoed.",
    "tech": "Restart INSTANCE-ID-{6}c0ffee with KUBECONFIG-EDGE{3}; not INSTANCE-{6}, nor KUBECONFIG {3}.",
    "personal": "Router password: owl{5}nest, home +44-212-555-{4}; not passwords, nor +44-212.",
}

# Sentences with one secret each, a near miss, and one with two secrets.
SECRET_SENTENCES = (
    "cloud key AKIA{16} in use",
    "session eyJhbGci{4}.eyJzdWIi{5}.sig_{6}-x ok",
    "push with ghp_{12}abc and go",
    "billing sk_live_{24} is live",
    "set DB_PASSWORD=pw{8} now",
    "nothing to see in order {6}",
    "almost AKIA{8} but short",
    "token: tok{9} and npm_{14}xyz",
)

# Sentences whose findings overlap in different ways.
OVERLAP_SENTENCES = (
    "mysql://user{3}:s3cret@10.0.0.{2}:3306/db and 10.1.2.{2}",
    "API_KEY=4111222233334{3} or 4111 2222 3333 4{3}",
    "token=alice{4}@corp.example.com next bob{4}@corp.example.com",
    "password: 555-{4}-call +1-312-555-{4}",
    "plain words only {5}",
)


def pick(sentences: tuple[str, ...], key: str) -> str:
    """One of several sentences, by key."""
    n = len(sentences)
    branches = " ".join(f"WHEN {i} THEN {sentence(s, key)}" for i, s in enumerate(sentences))
    return f"CASE {key} % {n} {branches} END"
