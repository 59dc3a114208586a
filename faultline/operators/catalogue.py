"""The packs at hand: which known changes they cover, as data for the transforms of ``packs``.

Names of packs, providers, fields, methods, paths and covered change ids are fixed values.
"""

from __future__ import annotations

import re

from ..functions import lexer
from ..functions import rewrite as W
from . import packs as P
from .packs import Pack, Rule


def ids(*parts: int | tuple[int, int]) -> tuple[int, ...]:
    """Single ids, and ranges with both ends."""
    return tuple(i for p in parts for i in ([p] if isinstance(p, int) else range(p[0], p[1] + 1)))


# What shows that a file talks to a vendor.
STRIPE = r"['\"]stripe['\"]|api\.stripe\.com|\bstripe\s*\."
PAYPAL = r"(?i)paypal"
VAULT = r"(?i)/v3/vault|payment[_-]?tokens|setup[_-]?tokens"
SUBSCRIPTIONS = r"(?i)/v1/billing/subscriptions|billing[_-]?subscriptions"
REFERRALS = r"(?i)/v2/customer/partner-referrals|partner[_-]?referrals"
VERCEL = r"(?i)\bvercel\b|/v\d+/projects\b"


def _all(*contexts: str):
    return lambda text: all(re.search(c, text) for c in contexts)


def _only(rule: Rule, *contexts: str) -> Rule:
    fits = _all(*contexts)
    return Rule(rule.about, rule.detect, lambda text: rule.apply(text) if fits(text) else text)


def withdrawn(name: str, provider: str, covers: tuple[int, ...], contexts: tuple[str, ...], groups: list[tuple[str, list[str]]], through: str | None = None) -> Pack:
    """R6 and R7: fields that are gone under an anchor, read and written, then their destructured names; a pattern is only
    cleaned if its right side ends in the anchor."""
    rules = []
    for anchor, fields in groups:
        rules.append(_only(P.drop_fields(fields, anchor), *contexts))
    for anchor, fields in groups:
        some = "|".join(map(re.escape, fields))

        def clean(text: str, anchor=anchor, fields=fields, some=some) -> str:
            sources = re.findall(rf"\{{[^{{}}]*\b(?:{some})\b[^{{}}]*\}}\s*=\s*([^;\n]*)", text)
            return P.clean_patterns(fields).apply(text) if sources and all(re.search(rf"(?:{anchor})[\w\[\]]*\s*\Z", s.strip()) for s in sources) else text

        rules.append(_only(Rule("clean up destructuring", some, clean), *contexts))
    return Pack(name, provider, tuple(rules), covers, revalidated_through=through)


def substitution(about: str, pattern: str, to: str, *contexts: str) -> Rule:
    """A pattern outside comment lines as another text."""
    fits = _all(*contexts)

    def apply(text: str) -> str:
        return "\n".join(x if re.match(r"\s*(?://|/?\*)", x) else re.sub(pattern, to, x) for x in text.split("\n")) if fits(text) else text

    return Rule(about, pattern, apply)


def _commands(text: str) -> str:
    """Request methods of the old object client as command objects."""
    some = "|".join(S3)
    out, at = [], 0
    for m in re.finditer(rf"\b(\w+)\.({some})\s*\(", text):
        close = W.closing(lexer.mask_code(text, "js"), m.end() - 1)
        end = re.compile(r"\s*\.promise\s*\(\)").match(text, close + 1) if close else None
        if end and m.start() >= at:
            out += [text[at : m.start()], f"{m.group(1)}.send(new {m.group(2)[0].upper()}{m.group(2)[1:]}Command({text[m.end() : close]}))"]
            at = end.end()
    return "".join((*out, text[at:]))


def _modular(text: str) -> str:
    """One import of what is used, if nothing of the old namespace is left."""
    m = re.search(r"const\s+AWS\s*=\s*require\(['\"]aws-sdk['\"]\);?", text)
    if not m or re.search(r"\bAWS\.", text.replace(m.group(), "")):
        return text
    used = sorted({"S3Client", *re.findall(r"new (\w+Command)\(", text)})
    return text.replace(m.group(), f"const {{ {', '.join(used)} }} = require('@aws-sdk/client-s3');")


S3 = ["getObject", "putObject", "deleteObject", "listObjectsV2", "headObject", "copyObject"]
BLOGS = "cms.blogs.blogPostsApi."
BLOG_BASIC = ["archive", "callClone", "create", "getById", "pushLive", "resetDraft", "schedule", "update", "updateDraft"]
BLOG_BATCH = {"archiveBatch": "archive", "createBatch": "create", "readBatch": "read", "updateBatch": "update"}
BLOG_LANGUAGE = ["attachToLangGroup", "createLangVariation", "detachFromLangGroup", "setLangPrimary", "updateLangs"]
ORDERS = {"ordersCreate": "createOrder", "ordersGet": "getOrder", "ordersPatch": "patchOrder", "ordersConfirm": "confirmOrder", "ordersAuthorize": "authorizeOrder", "ordersCapture": "captureOrder", "ordersTrackCreate": "createOrderTracking", "ordersTrackersPatch": "updateOrderTracking"}
PAYMENTS = {"authorizationsGet": "getAuthorizedPayment", "authorizationsCapture": "captureAuthorizedPayment", "authorizationsReauthorize": "reauthorizePayment", "authorizationsVoid": "voidPayment", "capturesGet": "getCapturedPayment", "capturesRefund": "refundCapturedPayment", "refundsGet": "getRefund"}
ORDER_ARGUMENTS = {
    "createOrder": ["body", "paypalMockResponse", "paypalRequestId", "paypalPartnerAttributionId", "paypalClientMetadataId", "prefer", "paypalAuthAssertion"],
    "getOrder": ["id", "paypalMockResponse", "paypalAuthAssertion", "fields"],
    "patchOrder": ["id", "paypalMockResponse", "paypalAuthAssertion", "body"],
    "confirmOrder": ["id", "paypalClientMetadataId", "paypalAuthAssertion", "prefer", "body"],
    "authorizeOrder": ["id", "paypalMockResponse", "paypalRequestId", "prefer", "paypalClientMetadataId", "paypalAuthAssertion", "body"],
    "captureOrder": ["id", "paypalMockResponse", "paypalRequestId", "prefer", "paypalClientMetadataId", "paypalAuthAssertion", "body"],
    "createOrderTracking": ["id", "body", "paypalAuthAssertion"],
    "updateOrderTracking": ["id", "trackerId", "paypalAuthAssertion", "body"],
}
PAYMENT_ARGUMENTS = {
    "getAuthorizedPayment": ["authorizationId", "paypalMockResponse", "paypalAuthAssertion"],
    "captureAuthorizedPayment": ["authorizationId", "paypalMockResponse", "paypalRequestId", "prefer", "paypalAuthAssertion", "body"],
    "reauthorizePayment": ["authorizationId", "paypalRequestId", "prefer", "paypalAuthAssertion", "body"],
    "voidPayment": ["authorizationId", "paypalMockResponse", "paypalAuthAssertion", "paypalRequestId", "prefer"],
    "getCapturedPayment": ["captureId", "paypalMockResponse"],
    "refundCapturedPayment": ["captureId", "paypalMockResponse", "paypalRequestId", "prefer", "paypalAuthAssertion", "body"],
    "getRefund": ["refundId", "paypalMockResponse", "paypalAuthAssertion"],
}
NAMED_IDS = ["deleteByIds", "getByIds", "getMeetingById", "replaceMeetingById", "updateMeetingById", "getPresetById", "getParticipantDataFromPeerId", "getWebhookById", "getActiveLivestreamsForLivestreamId", "getLivestreamSessionDetailsForSessionId", "getLivestreamSessionForLivestreamId"]
SLUGS = {
    "@cf/baai/omni-bge-base-en-v1.5": "@cf/baai/bge-base-en-v1.5", "@cf/baai/omni-bge-large-en-v1.5": "@cf/baai/bge-large-en-v1.5", "@cf/baai/omni-bge-m3": "@cf/baai/bge-m3",
    "@cf/baai/omni-bge-small-en-v1.5": "@cf/baai/bge-small-en-v1.5", "@cf/baai/ray-bge-large-en-v1.5": "@cf/baai/bge-large-en-v1.5", "@cf/facebook/omni-bart-large-cnn": "@cf/facebook/bart-large-cnn",
    "@cf/facebook/omni-detr-resnet-50": "@cf/facebook/nonomni-detr-resnet-50", "@cf/google/omni-embeddinggemma-300m": "@cf/google/embeddinggemma-300m", "@cf/huggingface/omni-distilbert-sst-2-int8": "@cf/huggingface/distilbert-sst-2-int8",
}
NAME_PARTS = ["prefix", "middle_name", "suffix", "full_name", "alternate_full_name"]
ADDRESS_PARTS = ["address_line_3", "admin_area_3", "admin_area_4", "address_details"]


def leading_to_options(moved: dict[str, list[str]]) -> Rule:
    """R10: leading path arguments of calls, found by the tail of their chain, into the options object behind the last one."""

    def apply(text: str) -> str:
        for tail, names in moved.items():

            def change(callee: str, args: list[str], names=names) -> str | None:
                n = len(names)
                if len(args) < n + 1 or any(a.startswith(("{", "`")) or "\n" in a for a in args[: n + 1]):
                    return None
                inner = args[n + 1][1:-1].strip().rstrip(",") if len(args) > n + 1 and args[n + 1].startswith("{") else ""
                fields = [k if k == a else f"{k}: {a}" for k, a in zip(names, args)]
                rest = args[n + 2 :] if len(args) > n + 1 else []
                return f"{callee}({', '.join([args[n], '{ ' + ', '.join([*fields, *([inner] if inner else [])]) + ' }', *rest])})"

            text = W.replace_calls(text, rf"(?:{W._NAME}\.)*{re.escape(tail)}", change)
        return text

    return Rule("path arguments into options", "|".join(re.escape(t.split(".")[-1]) for t in moved), apply)


def catalogue(moved: dict[str, list[str]] | None = None) -> list[Pack]:
    """All packs. ``moved`` names calls whose leading arguments become options (the last pack of that vendor uses it)."""
    controllers = lambda name, pairs: P.rename_calls({f"{name}.{a}": f"{name}.{b}" for a, b in pairs.items()})
    one = lambda name, provider, rules, covers=(), **more: Pack(name, provider, tuple(rules), covers, **more)
    return [
        one("openai-v3-to-v4", "openai", [
            Rule("import the client", r"['\"]openai['\"]", lambda t: re.sub(r"import\s*\{\s*Configuration\s*,\s*OpenAIApi\s*\}\s*from\s*(['\"])openai\1", r"import OpenAI from \1openai\1", re.sub(r"const\s*\{\s*Configuration\s*,\s*OpenAIApi\s*\}\s*=\s*require", "const OpenAI = require", t))),
            Rule("build the client", r"new\s+Configuration\s*\(", lambda t: re.sub(r"const\s+(\w+)\s*=\s*new\s+Configuration\s*\(\s*(\{[^{}]*\})\s*\);\s*const\s+(\w+)\s*=\s*new\s+OpenAIApi\s*\(\s*\1\s*\)", r"const \3 = new OpenAI(\2)", t)),
            *(Rule(f"rename {a}", rf"\.{a}\s*\(", lambda t, a=a, b=b: W.rename_call(t, rf"\.{a}\b", b)) for a, b in {"createChatCompletion": ".chat.completions.create", "createCompletion": ".completions.create", "createEmbedding": ".embeddings.create"}.items()),
            substitution("unwrap the response", r"\.data\.(?=choices\b|usage\b|data\[)", ".", r"['\"]openai['\"]"),
        ]),
        one("stripe-v7-to-v8", "stripe", [P.fold_setters(r"require\(['\"]stripe['\"]\)", {"setApiVersion": "apiVersion", "setTimeout": "timeout", "setMaxNetworkRetries": "maxNetworkRetries", "setHttpAgent": "httpAgent"})]),
        one("aws-sdk-v2-to-v3-s3", "aws", [
            Rule("commands", "|".join(rf"\.{m}\s*\(" for m in S3), _commands), substitution("read the body", r"\.Body\.toString\(", ".Body.transformToString("),
            substitution("client", r"new\s+AWS\.S3\s*\(", "new S3Client("), Rule("modular import", r"require\(['\"]aws-sdk['\"]\)", _modular),
        ]),
        one("stripe-node-v22-httpclient-interface", "stripe", [substitution("implement the interface", r"\bextends(\s+Stripe\s*\.\s*HttpClient(?:Response)?\b)", r"implements\1", STRIPE)], ids(134), revalidated_through="2026-07-30"),
        withdrawn("stripe-us-bank-preferred-settlement-speed-removal", "stripe", ids((44360, 44370), (44379, 44406), 44423), (STRIPE,), [(r"\.us_bank_account\??", ["preferred_settlement_speed"])], "2026-07-30"),
        withdrawn("stripe-terminal-tipping-bgn-removal", "stripe", ids((44371, 44378), (44407, 44422)), (STRIPE,), [(r"\.?tipping\??", ["bgn"])], "2026-07-30"),
        withdrawn("stripe-payment-record-card-details-removal", "stripe", ids((47041, 47080)), (STRIPE,), [(r"\.payment_method_details\??\.card\??", ["description", "iin", "issuer", "stored_credential_usage"])]),
        one("stripe-payment-record-boleto-tax-id-null-guard", "stripe", [substitution("guard against null", r"(payment_method_details\s*\??\.\s*boleto\s*\??\.\s*tax_id)\s*\.(?=\s*[A-Za-z_$])", r"\1?.", STRIPE)], ids((46650, 46659)), revalidated_through="2026-07-30"),
        withdrawn("stripe-legacy-card-iin-removal", "stripe", tuple(i for i in ids((60282, 61889)) if i not in (60910, 60911, 60912, 60913, 61039)), (STRIPE,), [(r"\bcard\??", ["iin"])]),
        one("cloudflare-kv-legacy-routes", "cloudflare", [substitution("path", r"workers/namespaces", "storage/kv/namespaces")], ids(1402)),
        one("shopify-customer-account-draftorder-price", "shopify", [substitution("field", r"\bdiscountedUnitPrice\b", "approximateDiscountedUnitPrice")], ids(1350)),
        one("shopify-customer-last-incomplete-checkout", "shopify", [P.selection_removed("lastIncompleteCheckout")], ids(1340)),
        one("shopify-marketing-engagement-cumulative", "shopify", [
            Rule("drop the flag", r"\bisCumulative\b", lambda t: re.sub(r"(?m)^[ \t]*isCumulative\s*(?::[^,\n]*)?,?[ \t]*\n", "", re.sub(r",\s*\$?isCumulative\s*:\s*[^,){}\n]+|\$?isCumulative\s*:\s*[^,){}\n]+,\s*", "", t))),
        ], ids(1347)),
        one("hubspot-blogposts-api-move", "hubspot", [
            P.rename_calls({f"{BLOGS}{m}": f"cms.blogs.basicApi.{m}" for m in BLOG_BASIC}), P.rename_calls({f"{BLOGS}{a}": f"cms.blogs.batchApi.{b}" for a, b in BLOG_BATCH.items()}), P.rename_calls({f"{BLOGS}{m}": f"cms.blogs.multiLanguageApi.{m}" for m in BLOG_LANGUAGE}),
        ], ids(689), chains=tuple(BLOGS + m for m in (*BLOG_BASIC, *BLOG_BATCH, *BLOG_LANGUAGE)), revalidated_through="2026-06-30"),
        one("shopify-order-fulfillment-not-required", "shopify", [P.mirror_case("UNFULFILLED", "FULFILLMENT_NOT_REQUIRED")], ids(1342)),
        one("twilio-verify-attempts-summary-servicesid", "twilio", [
            Rule("request parameter", r"Attempts/Summary", lambda t: "\n".join(re.sub(r"(?<!Verify)\bServiceSid\b", "VerifyServiceSid", x) if "Attempts/Summary" in x else x for x in t.split("\n"))),
            Rule("option", r"verificationAttemptsSummary", lambda t: W.replace_calls(t, rf"(?:{W._NAME}\.)*verificationAttemptsSummary(?:\(\))?\.fetch", lambda c, a: f"{c}({', '.join(re.sub(r'(?<![A-Za-z])serviceSid(?=\s*[:,}}])', 'verifyServiceSid', x) for x in a)})")),
        ], ids(3455)),
        one("twilio-messaging-brand-registration-a2p-casing", "twilio", [substitution("token", r"(?<![\w$])A2pProfileBundleSid(?![\w$])", "A2PProfileBundleSid")], ids(3769, 3770)),
        one("twilio-linkshortening-messagingservicesids-removal", "twilio", [
            Rule("form fields", r"MessagingServiceSids", lambda t: W.remove_lines(t, lambda x: bool(re.search(r"\.(?:set|append)\(\s*['\"]MessagingServiceSids(?:Action)?['\"]|^\s*['\"]?MessagingServiceSids(?:Action)?['\"]?\s*:", x)))),
            Rule("options", r"domainConfig", lambda t: W.remove_lines(t, lambda x: bool(re.match(r"\s*messagingServiceSids(?:Action)?\s*:", x)))),
        ], ids(3869, 3870)),
        one("paypal-server-sdk-v1-controller-renames", "paypal", [controllers("ordersController", ORDERS), controllers("paymentsController", PAYMENTS)], ids(627), controllers=(("OrdersController", "ordersController", tuple(ORDERS)), ("PaymentsController", "paymentsController", tuple(PAYMENTS))), revalidated_through="2025-11-06"),
        one("paypal-server-sdk-v2-options-object", "paypal", [P.name_arguments(rf"{c}\.{m}", a) for c, table in (("ordersController", ORDER_ARGUMENTS), ("paymentsController", PAYMENT_ARGUMENTS)) for m, a in table.items()], ids(625)),
        withdrawn("paypal-orders-v2-swish-pix-payment-source-removal", "paypal", ids((51196, 51216), (51222, 51246), (51248, 51268), (51271, 51291), (51294, 51318), (51320, 51340), (51343, 51363), (51366, 51390), (51392, 51412), (51415, 51435), (51441, 51465), (51468, 51488), (51491, 51511), (51514, 51534)), (PAYPAL,), [(r"\.?payment_source\??", ["swish", "pix"])]),
        withdrawn("paypal-vault-v3-wallet-profile-fields-removal", "paypal", ids((56612, 56615), (56621, 56646), (56660, 56685), (56709, 56734), (56743, 56768), (56798, 56823), (56825, 56850)), (PAYPAL, VAULT), [(r"\.(?:paypal|venmo)\??", ["birth_date", "tax_info"]), (r"\.(?:paypal|venmo)\??\.name\??", NAME_PARTS), (r"\.(?:paypal|venmo)\??\.address\??", ADDRESS_PARTS), (r"\.(?:paypal|venmo)\??\.tax_info\??", ["tax_id", "tax_id_type"])]),
        withdrawn("paypal-vault-v3-apple-pay-card-fields-removal", "paypal", ids((56647, 56651), (56735, 56739), (56769, 56773)), (PAYPAL, VAULT), [(r"\.apple_pay\??\.card\??", ["id", "number", "expiry", "security_code", "card_type"])]),
        withdrawn("paypal-vault-v3-information-link-error-field-removal", "paypal", ids((56609, 56611), (56618, 56620), (56655, 56658), (56686, 56689), (56777, 56781), (56851, 56854)), (PAYPAL, VAULT), [(r"\b(?:err|error|fault|body)\w*\??", ["information_link"])]),
        withdrawn("paypal-billing-subscriptions-v1-subscriber-address-removal", "paypal", ids((57284, 57300), (57333, 57349), (57376, 57392), (57422, 57438)), (PAYPAL, SUBSCRIPTIONS), [(r"\.subscriber\??", ["address"])]),
        withdrawn("paypal-billing-subscriptions-v1-shipping-address-trim", "paypal", ids((57301, 57310), (57350, 57359), (57393, 57402), (57439, 57448), (57460, 57475), (57479, 57494)), (PAYPAL, SUBSCRIPTIONS), [(r"\.shipping_address\??\.name\??", ["prefix", "given_name", "surname", "middle_name", "suffix", "alternate_full_name"]), (r"\.shipping_address\??\.address\??", ADDRESS_PARTS)]),
        withdrawn("paypal-billing-subscriptions-v1-subscriber-pii-removal", "paypal", ids((57280, 57283), (57329, 57332), (57372, 57375), (57418, 57421)), (PAYPAL, SUBSCRIPTIONS), [(r"\.subscriber\??", ["birth_date", "tax_info"]), (r"\.subscriber\??\.tax_info\??", ["tax_id", "tax_id_type"])]),
        withdrawn("paypal-partner-referrals-v2-office-bearers-removal", "paypal", ids((58051, 58059), (58077, 58125)), (PAYPAL, REFERRALS), [(r"\.?business_entity\??", ["office_bearers"])]),
        withdrawn("paypal-partner-referrals-v2-contact-detail-trim", "paypal", ids((58036, 58042), (58045, 58050), (58062, 58068), (58071, 58076)), (PAYPAL, REFERRALS), [(r"\.phones\??\.?\[[^\]]*\]\??", ["contact_name", "primary_mobile", "tags"]), (r"\.(?:phones|addresses)\??\.?\[[^\]]*\]\??", ["primary", "inactive"])]),
        one("paypal-invoicing-v2-error-link-method-enum-shrink", "paypal", [_only(P.drop_guards(["CONNECT", "HEAD", "OPTIONS"]), PAYPAL, r"(?i)invoicing", r"(?i)(?:err|error|fault)\w*\??\.?\w*link")], ids((57603, 57773), (57778, 57837))),
        one("paypal-invoicing-v2-send-202-body-unwrap", "paypal", [_only(P.unwrap(r"(?:invoic\w*\.)?send\w*", r"(?P<dot>\??\.)links\??\.?\[\s*0\s*\]\??\.(?=href|rel|method)", "."), PAYPAL, r"(?i)invoic")], ids((57774, 57777))),
        one("plaid-node-v43-v44-breaking-renames", "plaid", [
            Rule("one reason-code type", r"\b(?:Item|User)ProductsTerminateReasonCode\b", P.guarded(r"['\"]plaid['\"]", lambda t: W.merge_import(W.rename_identifier(W.rename_identifier(t, "ItemProductsTerminateReasonCode", "ProductsTerminateReasonCode"), "UserProductsTerminateReasonCode", "ProductsTerminateReasonCode"), "plaid", "ItemProductsTerminateReasonCode", "ProductsTerminateReasonCode"))),
            substitution("literal", r"(['\"])interest-only\1", r"\1interest only\1", r"['\"]plaid['\"]"),
            Rule("scalar to array", r"craCheckReportVerificationPdfGet", lambda t: re.sub(r"(craCheckReportVerificationPdfGet\s*\(\s*\{[^}]*?)\breport_requested(\s*:\s*)([^,\n}]+?)(?=\s*[,}\n])", r"\1reports_requested\2[\3]", t)),
        ], ids(42, 43), revalidated_through="2026-07-24"),
        withdrawn("vercel-web-analytics-dhe-cipher-suite-removal", "vercel", ids((5772, 5775)), (r"(?i)web[\s-]analytics",), [(r"\w\??", ["dheCipherSuite"])]),
        withdrawn("vercel-project-extended-max-duration-removal", "vercel", ids(6425, 6428, 6429, 6432, (6434, 6437), 6441, 6442, (6445, 6447), 6450, 6451, (6458, 6460), 6463, 6464), (VERCEL,), [(r"\.?resourceConfig\??", ["enableFunctionsExtendedMaxDuration"])]),
        withdrawn("vercel-project-public-source-removal", "vercel", ids(6427, 6431, 6433, 6438, 6440, 6444, 6449, 6457, 6462), (VERCEL,), [(r"\bproject\w*\??", ["publicSource"])]),
        one("vercel-store-agent-skill-url-to-agent-skills", "vercel", [substitution("scalar to array", r"(\??\.)agentSkillUrl\b", r"\1agentSkills?.[0]", VERCEL)], ids(4523)),
        one("vercel-vcr-image-id-or-digest-rename", "vercel", [Rule("option", r"getRepositoryImage", lambda t: W.replace_calls(t, rf"(?:{W._NAME}\.)*getRepositoryImage", lambda c, a: f"{c}({', '.join([re.sub(r'\bimageId(\s*:)', r'imageIdOrDigest\1', re.sub(r'([{,]\s*)imageId(?=\s*[,}])', r'\1imageIdOrDigest: imageId', a[0])), *a[1:]])})" if a and a[0].startswith("{") else None))], ids(5226)),
        one("vercel-integration-resource-edge-config-read-move", "vercel", [Rule("list and find", r"\bedgeConfig(?:SyncingEnabled|TokenId)\b", lambda t: re.sub(r"(?m)^([ \t]*)const\s+(\w+)\s*=\s*await\s+([\w$.]+)\(\s*`([^`\n]*/installations/\$\{[\w$.]+\}/resources)/\$\{(\w+)\}`([^)\n]*)\);[ \t]*$", r"\1const \2List = await \3(`\4`\6);\n\1const \2 = (\2List.resources || []).find((r) => r.partnerId === \5);", t))], ids(5222, 5223)),
        one("vercel-edge-config-to-global-config-path-rename", "vercel", [substitution("path", r"/(v1|experimentation)/edge-config\b", r"/\1/global-config")], ids((104126, 104137))),
        one("cloudflare-secrets-store-and-ai-security-path-renames", "cloudflare", [substitution("stores path", r"/system/accounts/(\$\{[^}]+\}|[^/\s'\"`]+)/stores\b", r"/accounts/\1/secrets_store/stores"), substitution("security path", r"/firewall-for-ai/", "/ai-security/")], ids((104146, 104150), 104152, 104153)),
        one("cloudflare-typescript-v7-deterministic-renames", "cloudflare", [
            Rule("method names", "|".join(rf"\.{m}\b" for m in NAMED_IDS), P.guarded(r"['\"]cloudflare", lambda t: _each(t, NAMED_IDS))),
            Rule("test types", r"\bDEXTest(?:Create|Update|Get|List)Response", lambda t: re.sub(r"\bDEXTest((?:Create|Update|Get|List)Response)", r"SchemaHTTP\1", t)),
            Rule("base class", r"\bAPIClient\b", lambda t: W.rename_identifier(re.sub(r"import\s*\{\s*APIClient\s*\}\s*from\s*(['\"])cloudflare/core\1", r"import { BaseCloudflare } from \1cloudflare/client\1", t), "APIClient", "BaseCloudflare") if re.search(r"APIClient\s*\}\s*from\s*['\"]cloudflare/core", t) else t),
            substitution("import paths", r"(['\"])cloudflare/src/", r"\1cloudflare/"),
            Rule("file helper", r"\bfileFromPath\b", lambda t: re.sub(r"(?:await\s+)?\bfileFromPath\(", "fs.createReadStream(", re.sub(r"import\s*\{\s*fileFromPath\s*\}\s*from\s*['\"]cloudflare['\"];?", "import fs from 'node:fs';", t)) if re.search(r"\{\s*fileFromPath\s*\}\s*from\s*['\"]cloudflare", t) else t),
        ], ids(141)),
        one("cloudflare-typescript-v7-named-path-params", "cloudflare", [leading_to_options(moved)] if moved else [], ids(141), chains=tuple(moved or ())),
        one("cloudflare-account-roles-to-permission-groups", "cloudflare", [substitution("path", r"(accounts/\$\{[^}]*\})/roles\b", r"\1/iam/permission_groups"), Rule("label", r"\.result\.(?:find|filter)\(", P.guarded(r"iam/permission_groups", lambda t: re.sub(r"(\.result\.(?:find|filter)\(\s*\(?(\w+)\)?\s*=>\s*\2)\.name\b", r"\1.meta.label", t)))], ids(1386)),
        one("cloudflare-workers-ai-model-slug-renames", "cloudflare", [P.replace_literals(SLUGS)], ids((104114, 104122))),
        one("firebase-ai-vertexai-to-agent-platform-backend", "firebase", [
            Rule("pin the location", r"new\s+VertexAIBackend\s*\(\s*\)", lambda t: W.replace_calls(t, r"new\s+VertexAIBackend", lambda c, a: None if a else "new AgentPlatformBackend('us-central1')")),
            Rule("rename", r"\bVertexAIBackend\b", lambda t: W.rename_identifier(t, "VertexAIBackend", "AgentPlatformBackend")),
        ], ids(103612)),
        one("slack-cli-hooks-file-move", "slack", [substitution("quoted path", r"(['\"`])(?:\./)?slack\.json(?=['\"`])", r"\1.slack/hooks.json")], ids(1377), moves=(("slack.json", ".slack/hooks.json"),)),
        one("slack-sdk-v8-errors", "slack", [
            P.type_tests("@slack/web-api", {"PlatformError": "WebAPIPlatformError", "RequestError": "WebAPIRequestError", "HTTPError": "WebAPIHTTPError", "RateLimitedError": "WebAPIRateLimitedError"}, "ErrorCode"),
            P.type_tests("@slack/webhook", {"RequestError": "IncomingWebhookRequestError", "HTTPError": "IncomingWebhookHTTPError"}, "ErrorCode"),
            P.type_tests("@slack/socket-mode", {"WebsocketError": "SMWebsocketError", "NoReplyReceivedError": "SMNoReplyReceivedError"}, "ErrorCode"),
        ], ids(31, 32, 34)),
    ]


def _each(text: str, names: list[str]) -> str:
    for name in names:
        text = W.rename_call(text, rf"\.{name}\b", "." + re.sub(r"Id(s?)$", r"ID\1", name))
    return text
