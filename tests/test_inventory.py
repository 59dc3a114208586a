"""Files, usage, bindings and the module graph on a small tree written here."""

import pytest

from faultline.plans import inventory as I
from faultline.sources import feeds, files

TREE = {
    "app/pay.js": "import Stripe from 'stripe';\nconst pay = new Stripe(process.env.STRIPE_KEY);\nconst subs = pay.subscriptions;\nexport const shared = pay;\nexport default pay;\nsubs.list();\npay.charges.create({});\n// pay.gone.call()\nfetch(`https://api.stripe.com/v1/charges/${id}/refund`);\n",
    "app/twice.js": "import Stripe from 'stripe';\nlet a = new Stripe(k);\na = other();\na.charges.create();\n",
    "app/derived.js": "import Stripe from 'stripe';\nconst c = new Stripe(k).customers;\nc.list();\n",
    "app/other.js": "const text = \"import Stripe from 'stripe'\";\nfoo.charges.create();\n",
    "lib/index.js": "export { shared as payments } from '../app/pay';\nexport * from '../app/pay';\n",
    "use/a.js": "import { payments } from '../lib';\nimport pay from '../app/pay.js';\nimport * as all from '../app/pay';\npayments.refunds.create();\npay.payouts.list();\nall.shared.topups.create();\n",
    "use/b.ts": "import { HubSpot, Client } from '@hubspot/api-client';\nconst hub = new Client({});\nhub.getContact(1);\n",
    "m.py": "import boto3\nfrom slack_sdk import WebClient\nslack = WebClient(token=os.environ['SLACK_TOKEN'])\nslack.chat.postMessage(x=1)\n'''\nimport stripe\n'''\n",
    "m.go": "package main\nimport \"github.com/stripe/stripe-go/v72\"\nfunc f() {\n\tc := stripe.NewClient(k)\n\tc.Charges.List(1)\n}\n",
    "m.rb": "require 'stripe'\nclient = Stripe::Client.new(key)\nclient.charges.create(1)\n",
    "m.php": "<?php\nuse Twilio\\Rest\\Client;\n$t = new Client($sid);\n$t->messages->create(1);\n",
    "node_modules/x.js": "import Stripe from 'stripe';",
    ".hidden/x.js": "import Stripe from 'stripe';",
    "notes.md": "stripe",
    "big.js": "import Stripe from 'stripe';" + " " * 1_000_001,
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return files.tree(spark, f"file://{root}").cache()


def test_tree(tree):
    assert {r.path for r in tree.collect()} == set(TREE) - {"node_modules/x.js", ".hidden/x.js", "notes.md", "big.js"}


def test_usage(tree):
    got = {(r.provider, r.kind, r.file, r.line) for r in files.usage(tree).collect()}
    assert {("stripe", "import", "app/pay.js", 1), ("stripe", "env-var", "app/pay.js", 2), ("stripe", "api-host", "app/pay.js", 9), ("aws", "import", "m.py", 1), ("slack", "import", "m.py", 2), ("slack", "env-var", "m.py", 3)} <= got
    assert {("stripe", "import", "m.go", 2), ("stripe", "import", "m.rb", 1), ("twilio", "import", "m.php", 2)} <= got
    assert not any(f == "m.py" and p == "stripe" for p, _, f, _ in got)


@pytest.fixture(scope="module")
def found(tree):
    return I.inventory(I.surfaces(tree)).cache()


def test_calls_with_proven_roots(found):
    got = {(r.surface, s.file, s.line) for r in found.where("kind = 'sdk-call'").collect() for s in r.sites}
    assert got == {
        ("stripe client.subscriptions.list", "app/pay.js", 6), ("stripe client.charges.create", "app/pay.js", 7), ("stripe client.refunds.create", "use/a.js", 4), ("stripe client.payouts.list", "use/a.js", 5), ("stripe client.topups.create", "use/a.js", 6),
        ("@hubspot/api-client client.getContact", "use/b.ts", 3), ("slack_sdk client.chat.postMessage", "m.py", 4), ("github.com/stripe/stripe-go client.Charges.List", "m.go", 5), ("stripe client.charges.create", "m.rb", 3), ("Twilio client.messages.create", "m.php", 4),
    }
    assert {r.surface for r in found.where("kind = 'endpoint'").collect()} == {"/v1/charges/{param}/refund"}
    assert "@hubspot/api-client Client hub.getContact" in {r.surface for r in found.where("kind = 'controller-call'").collect()}


def test_endpoints_of_whole_lines(spark):
    """Paths far behind a snippet's end count, also in one line of a million characters, each for the provider whose host it follows."""
    far = lambda n, *calls: "f('" + "x" * n + "');" + " ".join(f"fetch('https://{c}');" for c in calls)
    texts = {"near.js": far(5, "api.stripe.com/v1/near"), "far.js": "go();\n" + far(300, "api.stripe.com/v1/far", "api.openai.com/v1/files"), "min.js": far(1_000_000, "api.stripe.com/v1/min"), "none.js": far(300)}
    made = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = [(r.provider, r.surface, r.file, r.line, len(r.snippet)) for r in I.surfaces(made).where("kind = 'endpoint'").collect()]
    assert sorted(got) == [("openai", "/v1/files", "far.js", 2, 200), ("stripe", "/v1/far", "far.js", 2, 200), ("stripe", "/v1/min", "min.js", 1, 200), ("stripe", "/v1/near", "near.js", 1, 51)]


def test_matches(spark, found):
    changes = spark.createDataFrame([(1, "stripe", "path-removed: POST /v1/charges/{id}/refund", "breaking", "u"), (2, "stripe", "POST /v1/charges/{id}/refund", "additive", "u"), (3, "slack", "POST /v1/charges/{id}/refund", "breaking", "u"), (4, "stripe", "POST /v2/x", "breaking", "u")], "id long, provider string, title string, change_type string, source_url string")
    assert [r.change_id for r in I.touched(found, changes).collect()] == [1]
    packs = spark.createDataFrame(
        [("p", "stripe", ["GET /v1/charges"], ["charges.create", "create"], []), ("h", "hubspot", [], [], [("Client", "hub", ["getContact"])]), ("q", "stripe", [], ["client.charges.create"], [])],
        "pack string, provider string, surfaces array<string>, chains array<string>, controllers array<struct<ctor:string,anchor:string,methods:array<string>>>",
    )
    got = {(r.pack, r.kind, r.declared) for r in I.packs_touched(found, packs).collect()}
    assert got == {("p", "endpoint", "GET /v1/charges"), ("p", "sdk-call", "charges.create"), ("p", "sdk-call", "create"), ("h", "controller-call", "hub.getContact")}


def test_feeds(spark):
    atom = "<feed><entry><title>v2.0.0</title><updated>2024-03-01T00:00:00Z</updated><link href=\"u1\"/><content type='html'>&lt;p&gt;Removed &amp;amp; gone&lt;/p&gt;</content></entry><entry><title></title></entry></feed>"
    rss = "<rss><item><title><![CDATA[Adds <b>x</b>]]></title><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate><link>u2</link><description>new endpoint</description></item><item><title>z</title><pubDate>never</pubDate><link>u1</link><content:encoded>docs</content:encoded></item></rss>"
    found = feeds.entries(spark.createDataFrame([("a", "atom", atom), ("b", "rss", rss), ("c", "rss", "oops")], "source string, kind string, xml string"))
    providers = spark.createDataFrame([("a", "acme", "acme/sdk"), ("b", "acme", "changelog:acme")], "source string, provider string, source_repo string")
    got = {(r.title, r.change_type, r.effective_date, r.source_url, r.raw_excerpt.strip()) for r in feeds.changes(found, providers, "2024-04-01 00:00:00").collect()}
    assert got == {("v2.0.0", "breaking", "2024-03-01", "u1", "Removed &amp; gone"), ("Adds <b>x</b>", "additive", "2024-03-01", "u2", "new endpoint"), ("z", "docs-only", None, "u1", "docs")}


def test_feed_failures(spark):
    rows = [("a", "atom", "<feed><entry></entry></feed>"), ("b", "rss", None), ("c", "rss", "<html>gone</html>"), ("d", "atom", "<feed><entry>"), ("e", "rss", "<rss></rss>")]
    got = {(r.source, r.error) for r in feeds.failures(spark.createDataFrame(rows, "source string, kind string, xml string")).collect()}
    assert got == {("b", "empty"), ("c", "not a feed"), ("d", "cut off"), ("e", "no entries")}
