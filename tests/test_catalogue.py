"""A text that each pack changes, and what is left alone; twice is as once."""

import re

import pytest

from faultline import cases
from faultline.operators.catalogue import catalogue

PACKS = {p.name: p for p in catalogue({"aiGateway.logs.get": ["gateway_id"]})}
CASES = cases.PACKS


def run(pack, text):
    for rule in pack.rules:
        if re.search(rule.detect, text):
            text = rule.apply(text)
    return text


@pytest.mark.parametrize("name,text,want", CASES)
def test_pack(name, text, want):
    assert run(PACKS[name], text) == want
    assert run(PACKS[name], want) == want


def test_every_pack_has_a_case():
    assert {c[0] for c in CASES} == set(PACKS) and len(PACKS) == 47


@pytest.mark.parametrize("pack", PACKS.values(), ids=PACKS)
def test_prose_stays(pack):
    text = "// stripe paypal vercel: createCompletion( setTimeout( iin swish tags\nconst plain = 'nothing here';\n"
    assert run(pack, text) == text


def test_coverage_counts():
    counts = {"stripe-legacy-card-iin-removal": 1603, "paypal-orders-v2-swish-pix-payment-source-removal": 310, "paypal-vault-v3-wallet-profile-fields-removal": 160, "paypal-invoicing-v2-error-link-method-enum-shrink": 231, "vercel-project-extended-max-duration-removal": 20, "cloudflare-secrets-store-and-ai-security-path-renames": 7}
    assert {k: len(PACKS[k].covers) for k in counts} == counts
