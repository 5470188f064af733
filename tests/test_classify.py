import pytest

from datawarden.config import Settings
from datawarden.operators.classify import apply_refinements, classify_samples as classify, review_queue

EMAILS = lambda n: [f"u{i}@x.io" if i < n else f"plain{i}" for i in range(100)]

# name -> (header, samples)
CASES = {
    "email": ("email", ["ada@x.io", "bob@y.com", "c@z.org"]),
    "phone": ("phone", ["+1 (415) 555-0132", "9876543210"]),
    "ssn": ("ssn", ["123-45-6789", "078-05-1120"]),
    "cc": ("cc", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
    "dob": ("date_of_birth", ["1985-04-12", "1990-11-30"]),
    "full_name": ("full_name", ["Ada Lovelace", "Grace Hopper"]),
    "address": ("address", ["221B Baker St", "10 Downing St"]),
    "ip": ("ip_address", ["192.168.1.1", "10.0.0.5"]),
    "ipv6": ("host", ["2001:db8:0:0:0:0:0:1", "FE80:0:0:0:0:0:0:2"]),
    "zip": ("zip_code", ["94107", "94107-1234"]),
    "score": ("score", ["87", "91", "78"]),
    "handle": ("handle", ["@ada", "a@b", "not-an-email"]),
    "ref_dates": ("ref", ["2020-01-01", "2021-06-15"]),
    "num16": ("num", ["4111111111111111", "4111111111111111"]),
    "customer_id": ("customer_id", ["1", "2", "3", "4", "5"]),
    "no_luhn": ("ref", ["4111 1111 1111 1112", "4111 1111 1111 1113"]),
    "signup": ("signup_date", ["2023-01-15", "2023-02-20"]),
    "city": ("city", ["New York", "St. Louis"]),
    "bad_ip": ("val", ["999.1.1.1", "1.2.3", "256.256.256.256"]),
    "year": ("year", ["2024", "2023"]),
    "user_id": ("user_id", ["12345", "23456"]),
    "e71": ("field", EMAILS(71)),
    "e69": ("field", EMAILS(69)),
    "empty": ("whatever", []),
    "strong_conflict": ("phone", ["a@x.io", "b@x.io"]),
    "weak_conflict": ("full_name", ["a@x.io", "b@x.io"]),
    "partial_strong": ("e-mail", ["a@x.io", "b", "c"]),
    "partial_weak": ("name", ["a@x.io", "b", "c"]),
    "low_strong": ("email", ["a@x.io", "b", "c", "d"]),
    "non_ascii": ("ñname", ["x"]),
    "padded": ("mail box", ["  a@x.io ", " b@x.io"]),
}


@pytest.fixture(scope="module")
def columns(spark):
    rows = [(k, 0, h, v) for k, (h, v) in CASES.items()]
    return spark.createDataFrame(
        rows, "dataset_id string, position int, name string, sample_values array<string>"
    )


@pytest.fixture(scope="module")
def tags(columns):
    return {r["dataset_id"]: r for r in classify(columns).collect()}


def test_true_positives(tags):
    expected = {
        "email": ("EMAIL", "HIGH"), "phone": ("PHONE", "HIGH"), "ssn": ("ID_NUMBER", "HIGH"),
        "cc": ("CREDIT_CARD", "HIGH"), "dob": ("DATE_OF_BIRTH", "HIGH"),
        "full_name": ("NAME", "MEDIUM"), "address": ("ADDRESS", "MEDIUM"),
        "ip": ("IP_ADDRESS", "MEDIUM"), "ipv6": ("IP_ADDRESS", "MEDIUM"),
        "zip": ("POSTAL_CODE", "LOW"), "score": ("NONE", "NONE"), "non_ascii": ("NAME", "MEDIUM"),
        "padded": ("EMAIL", "HIGH"),
    }
    assert {k: (tags[k]["category"], tags[k]["sensitivity"]) for k in expected} == expected
    assert tags["email"]["confidence"] == 1.0 and not tags["email"]["needs_review"]
    assert tags["full_name"]["confidence"] == pytest.approx(0.6)
    assert tags["score"]["confidence"] is None and tags["score"]["source"] == "AUTO_REGEX"


def test_false_positives(tags):
    for case in ("customer_id", "signup", "city", "year", "user_id", "empty", "handle",
                 "ref_dates", "num16", "no_luhn"):
        expected = "CREDIT_CARD" if case == "num16" else "NONE"
        assert tags[case]["category"] == expected, case
    assert not tags["empty"]["needs_review"]
    # Out-of-range octets are no address; one of the three has the shape of a phone number,
    # which leaves the column ambiguous.
    assert (tags["bad_ip"]["category"], tags["bad_ip"]["needs_review"]) == ("PHONE", True)


def test_threshold_and_conflicts(tags):
    assert (tags["e71"]["category"], tags["e71"]["needs_review"]) == ("EMAIL", False)
    assert tags["e71"]["confidence"] == pytest.approx(0.71)
    assert tags["e69"]["needs_review"] and tags["e69"]["category"] == "EMAIL"
    assert tags["strong_conflict"]["needs_review"]
    assert (tags["weak_conflict"]["category"], tags["weak_conflict"]["needs_review"]) == ("EMAIL", False)
    assert tags["partial_strong"]["needs_review"]
    assert tags["partial_strong"]["confidence"] == pytest.approx(1 / 3)
    assert (tags["partial_weak"]["category"], tags["partial_weak"]["needs_review"]) == ("NAME", False)
    assert (tags["low_strong"]["category"], tags["low_strong"]["confidence"]) == ("EMAIL", 0.6)


def test_settings_reach_the_tags(columns):
    s = Settings().with_overrides(
        {"classify_threshold": 0.6, "sensitivity": {**Settings().sensitivity, "EMAIL": "LOW"}}
    )
    got = {r["dataset_id"]: r for r in classify(columns, s).collect()}
    assert not got["e69"]["needs_review"] and got["e69"]["sensitivity"] == "LOW"


def test_review_queue_and_refinements(spark, columns):
    tags = classify(columns)
    queue = {r["dataset_id"]: r for r in review_queue(tags, columns).collect()}
    assert set(queue) == {"e69", "strong_conflict", "partial_strong", "bad_ip"}
    assert len(queue["e69"]["sample_values"]) == 10
    labels = spark.createDataFrame(
        [
            ("e69", 0, "OTHER", "bogus", "0.9", 1),
            ("strong_conflict", 0, "NOT_ONE", "HIGH", "0.9", 1),
            ("partial_strong", 0, "EMAIL", "LOW", "often", 1),
            ("partial_strong", 0, "NAME", "MEDIUM", "often", 2),
            ("email", 0, "NONE", "NONE", "1", 1),
        ],
        "dataset_id string, position int, category string, sensitivity string, confidence string, "
        "labelled_at int",
    )
    got = {r["dataset_id"]: r for r in apply_refinements(tags, labels).collect()}
    assert [got["e69"][c] for c in ("category", "sensitivity", "confidence", "source")] == [
        "OTHER", "LOW", 0.9, "AUTO_AI",
    ]
    assert got["strong_conflict"]["source"] == "AUTO_REGEX"
    assert [got["partial_strong"][c] for c in ("category", "sensitivity", "confidence")] == [
        "NAME", "MEDIUM", None,
    ]
    assert got["email"]["category"] == "EMAIL"
