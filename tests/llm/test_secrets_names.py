"""Names and values on the border: keys of any owner, numbers."""

import pytest

from lodesift.llm.secrets import Finder, mask

KEY = "sk_live_9aQ2xLmT7vRk4WzP8bNc"


@pytest.fixture(scope="module")
def finder():
    return Finder()


@pytest.mark.parametrize("name", ["STRIPE_KEY", "GITHUB_KEY", "AWS_KEY", "mapsKey", "BILLING_KEY", "DATA_KEY", "vault_key"])
def test_a_key_of_any_owner_is_tested_for_a_residual(finder, name):
    text = f'{name} = "{KEY}"'
    got = finder.find(text, "a.py")
    assert [(f.start, f.end) for f in got] == [(len(name) + 4, len(text) - 1)] and mask(text, got) == f'{name} = "REDACTED"'
    assert finder.find(f'{name} = "orders by region"', "a.py") == []


@pytest.mark.parametrize("name", ["public_key", "cacheKey", "SORT_KEY", "foreign_key", "partitionKey", "primary_key", "unique_key", "idempotencyKey", "dedupe_key"])
def test_keys_that_are_no_secrets(finder, name):
    assert finder.find(f'{name} = "{KEY}"', "a.py") == []


@pytest.mark.parametrize("text, value", [('password = "84629173"', "84629173"), ("passcode: 4938271650", "4938271650"), ("DB_PASSWORD=731946", "731946")])
def test_a_long_number_under_a_strong_name_is_found(finder, text, value):
    for path in ("a.yml", "a.env"):
        assert [(f.start, f.end) for f in finder.find(text, path)] == [(text.index(value), text.index(value) + len(value))]


@pytest.mark.parametrize("text", ['password = "12345"', "token: 3.14159", "token: 3600s", "max_tokens: 131072", "token_ttl=86400000"])
def test_short_numbers_and_measures_are_none(finder, text):
    assert finder.find(text, "a.yml") == []
