"""Reference cases: what must be gone, and which placeholders must appear."""

import pytest

from hushframe.functions.catalog import PROFILES, rules_for
from hushframe.operators import mask
from hushframe.sources.rulebook import check_rules

# Fixed values: (profile, input, values that must not survive).
PROFILE_CASES = [
    ("General", "Call Alice Vance at 555-0199 or email alice@vance.com", ["Alice Vance", "555-0199", "alice@vance.com"]),
    ("Dev", "Production connection mysql://db_admin:P@ssw0rd2026!@10.0.4.15:3306/prod_db and secret sk-proj-49a2fb31c9a10293",
     ["db_admin", "P@ssw0rd2026!", "sk-proj-49a2fb31c9a10293"]),
    ("Medical", "Patient MRN-981200. Prescribed: Amoxicillin. NPI: 1902910291", ["MRN-981200", "1902910291"]),
    ("Pharma", "Subject ID SUBJ9012. Protocol ID IND-902. Lot Number LOT-8912.", ["SUBJ9012", "IND-902", "LOT-8912"]),
    ("Legal", "Case reference CASE-8912 and docket CV-26-8912.", ["CASE-8912", "CV-26-8912"]),
    ("Compliance", "Audit report GDPR-AUDIT-2026 and DSAR-8912.", ["GDPR-AUDIT-2026", "DSAR-8912"]),
    ("CCPA", "CCPA Driver License: DL-902192. Account ID: ACC902100.", ["DL-902192", "ACC902100"]),
    ("Finance", "Card Number: 4111-2222-3333-4444 Routing: PORTFOLIO-12345.", ["4111-2222-3333-4444", "PORTFOLIO-12345"]),
    ("Bizops", "Deal: DEAL-1234. Signed NDA-9021.", ["DEAL-1234", "NDA-9021"]),
    ("Sales", "Opportunity OPPORTUNITY-12345. Current ARR $250K.", ["OPPORTUNITY-12345", "$250K"]),
    ("WealthMgmt", "Routing: 021000021. Net Worth: $14M.", ["021000021", "$14M"]),
    ("Insurance", "Claim #POL992109. VIN: 1FTFW1EF5GFA12345.", ["POL992109", "1FTFW1EF5GFA12345"]),
    ("Accounting", "EIN: 12-3456789. Tax Refund: $82450.", ["12-3456789", "$82450"]),
    ("HR", "EEID 12345. DOB: 11/12/1993.", ["12345", "11/12/1993"]),
    ("Security", "Vulnerability CVE-2026-9901 on IP 172.16.254.1.", ["CVE-2026-9901", "172.16.254.1"]),
    ("Marketing", "Lead: LEAD-90210. Campaign: CAMPAIGN-1234567890.", ["LEAD-90210", "CAMPAIGN-1234567890"]),
    ("Support", "Ticket TICKET-12345. Zendesk: ZENDESK-9021.", ["TICKET-12345", "ZENDESK-9021"]),
    ("RealEstate", "MLS 902100. GATE CODE 1234.", ["902100", "1234"]),
    ("Agents", "Vector VECTOR-90210210.", ["VECTOR-90210210"]),
    ("Academic", "Student STUDENT-89120. Policy: FERPA-90210.", ["STUDENT-89120", "FERPA-90210"]),
    ("Creative", "This draft DRAFT-8912 is EMBARGOED.", ["DRAFT-8912", "EMBARGOED"]),
    ("Tech", "Instance INSTANCE-ID-a092f1b0a92. Config: KUBECONFIG-PROD12.", ["INSTANCE-ID-a092f1b0a92", "KUBECONFIG-PROD12"]),
    ("Personal", "PASSWORD: greenmonster. MOM: +1-312-555-0182.", ["greenmonster", "+1-312-555-0182"]),
]


def masked(spark, text, **kwargs):
    return mask.sanitize(spark.createDataFrame([(text,)], "text string"), **kwargs).first()["masked_text"]


def test_every_profile_has_a_case():
    assert sorted(p.lower() for p, _, _ in PROFILE_CASES) == sorted(PROFILES)


@pytest.mark.parametrize("profile,text,gone", PROFILE_CASES, ids=[c[0] for c in PROFILE_CASES])
def test_profile_masks(spark, profile, text, gone):
    out = masked(spark, text, profile=profile)
    assert not [value for value in gone if value in out], out


def test_profiles_per_row_agree_with_fixed_profiles(spark):
    rows = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(PROFILE_CASES)], "id int, profile string, text string")
    from hushframe.operators.guards import require_profile

    good, bad = require_profile(rows)
    assert bad.count() == 0
    by_row = {r["id"]: r["masked_text"] for r in mask.sanitize_by_profile(good).collect()}
    assert by_row == {i: masked(spark, t, profile=p) for i, (p, t, _) in enumerate(PROFILE_CASES)}


# The first three inputs and results.
@pytest.mark.parametrize("text,expected", [
    ("Contact me at dev-key-1234 or jane.doe@company.com", "Contact me at [SECRET_1] or [EMAIL_1]"),
    ("Name: John Doe, Email: john.doe@example.com, Phone: +1-555-123-4567",
     "Name: [NAME_1], Email: [EMAIL_1], Phone: [PHONE_1]"),
    ("This draft is EMBARGOED", "This draft is EMBARGOED"),
    ("", ""),
    ("a@b.io, c@d.io, a@b.io", "[EMAIL_1], [EMAIL_2], [EMAIL_1]"),
    ("A@b.io and a@b.io", "[EMAIL_1] and [EMAIL_2]"),
    ("seen [EMAIL_4] and new x@y.org", "seen [EMAIL_4] and new [EMAIL_5]"),
    ("[EMAIL_2147483647] x@y.org", "[EMAIL_2147483647] [EMAIL_2147483648]"),
    ("[EMAIL_99999999999999999999] x@y.org", "[EMAIL_99999999999999999999] [EMAIL_1]"),
    ("😀é x@y.org ü", "😀é [EMAIL_1] ü"),
])
def test_general_masking(spark, text, expected):
    assert masked(spark, text) == expected


# The input texts of the next three tests.
def test_medical_keeps_base_rules(spark):
    out = masked(spark, "Patient John Doe, SSN: 123-45-6789", profile="Medical")
    assert "[NAME_1]" in out and "[ID_1]" in out


def test_text_file_case(spark):
    out = masked(spark, "API Key: secret-key-value-12345\nUser: jane.smith@company.com", profile="Dev")
    assert "secret-key-value-12345" not in out and "jane.smith@company.com" not in out


def test_custom_rule_cases(spark):
    rules, rejected = check_rules(spark, [
        {"pattern": "Project-Apollo", "label": "my_project"},
        {"regex": "sk-special-[a-z0-9]+", "category": "CONFIDENTIAL_CODE"},
        {"pattern": "SECRET_TEST_PAT", "label": "TEST_SECRET"},
    ])
    assert not rejected
    text = "The codebase for Project-Apollo is located on server. Key is sk-special-987241. SECRET_TEST_PAT"
    out = masked(spark, text, rules=rules_for("general", rules))
    assert "[MY_PROJECT_1]" in out and "[CONFIDENTIAL_CODE_1]" in out and "[TEST_SECRET_1]" in out


def test_unknown_profile_is_an_error():
    with pytest.raises(ValueError):
        rules_for("astrology")


def test_null_profile_means_general():
    assert rules_for(None) == rules_for("  General ")
