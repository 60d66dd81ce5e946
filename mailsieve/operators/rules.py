"""The detectors: message rules over the context row, link rules over the link rows, wording over the words.

A rule is data: id, category, severity, score and a condition. All conditions of one frame are evaluated in one
projection, so a message costs one pass however many rules there are; a rule that takes several severities is listed
once for each, the conditions excluding each other. Wording is searched in words, so no pattern needs word boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..config import BOUNDS
from ..dialect import IPV4, PRIVATE_IPV4, Dialect
from ..refdata import (
    ACTION_SUBJECT,
    ACTION_WORDING,
    ARCHIVE,
    COMBINATIONS,
    CONDITIONAL,
    DANGEROUS_SCHEMES,
    DECOY,
    DELIVERED,
    DENIABLE,
    DENIED,
    DISK_IMAGE,
    ENTERED,
    EXECUTABLE,
    EXECUTIVE_TITLES,
    FORGED_ASSURANCE,
    FREEMAIL,
    GENERIC_GREETING,
    INSTITUTIONAL_MARKERS,
    LANGUAGE_MARKERS,
    MACRO,
    ORGANISATION_MARKERS,
    PLATFORMS,
    PRIVATE_TLDS,
    ROLE_NAMES,
    SCRIPT_CONTAINER,
    SIGN_IN_WORDING,
    THEMES,
    UNSUBSCRIBE,
)

DEPARTMENTS = "hr|human resources|payroll|it|helpdesk|help desk|it support|finance|accounting|accounts payable|management|admin|compliance"
HIDDEN = "[​-‏‪-‮⁠-⁤⁦-⁩﻿­]"
BIDI = "[‪-‮⁦-⁩]"
STYLED = r"[\x{1D400}-\x{1D7FF}\x{2102}\x{210A}-\x{2113}\x{2115}\x{2119}-\x{211D}\x{2124}\x{212C}-\x{2138}]"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    score: int
    when: str
    cap: int = BOUNDS.findings_per_rule

    @property
    def category(self) -> str:
        return self.id.partition(".")[0]


def authentication(q: Dialect) -> list[Rule]:
    own = "registrable <> '' AND signed_registrable <> '' AND signed_registrable <> registrable AND NOT platform_signed"
    via = "via_registrable <> '' AND via_registrable <> registrable"
    return [
        Rule("authentication.failure", "high", 35, "auth_failed AND dmarc <> 'pass'"),
        Rule("authentication.partial_failure", "low", 8, "auth_failed AND dmarc = 'pass'"),
        Rule("authentication.signing_domain_mismatch", "medium", 20, f"{own} AND claim_id IS NOT NULL"),
        Rule("authentication.signing_domain_mismatch", "low", 8, f"{own} AND claim_id IS NULL"),
        Rule("authentication.via_unrelated_host", "medium", 18, f"{via} AND claim_id IS NOT NULL AND claim_domain <> via_registrable"),
        Rule("authentication.via_unrelated_host", "info", 0, f"{via} AND (claim_id IS NULL OR claim_domain = via_registrable)"),
        Rule("authentication.gmail_warning", "high", 30, "provider_warning"),
        Rule("authentication.unverified_sender", "medium", 20, "unauthenticated AND spf NOT IN ('fail', 'softfail') AND dkim NOT IN ('fail', 'softfail')"),
        Rule("authentication.passed", "info", 0, "auth_passed"),
    ]


def identity(q: Dialect) -> list[Rule]:
    stranger = "claim_id IS NOT NULL AND claim_domain <> registrable AND registrable <> ''"
    outside = "recipient_registrable <> '' AND recipient_registrable <> registrable"
    reply = "reply_registrable <> '' AND registrable <> '' AND reply_registrable <> registrable"
    tld = q.extract("sender_domain", r"([^.]+)$")
    known = q.delegated("sender_domain")
    ip = q.match("sender_domain", IPV4)
    odd = f"sender_domain <> '' AND ({q.match('sender_domain', r'[^a-z0-9.-]')} OR sender_domain NOT LIKE '%.%')"
    deep = "length(sender_domain) - length(replace(sender_domain, '.', '')) - (length(registrable) - length(replace(registrable, '.', ''))) > 4"
    close = "levenshtein(sender_core, recipient_core)"
    families = [" (password|sign in|login|verify|verification) ", " (security|unusual|suspicious|alert|warning) ", " (suspended|blocked|expired?|locked|final|overdue) "]
    alerts = "(" + " + ".join(f"CASE WHEN {q.match('subject_words', f)} THEN 1 ELSE 0 END" for f in families) + ")"
    shared = q.match("subject_words", " (shared|sent|sign|signature|invited) ( ?[^ ]+ ){0,4}?(file|document|folder|item|form|agreement) ")
    confused = "sender_skeleton = recipient_skeleton AND sender_core <> recipient_core"
    generic = "team support service services notification notifications alert alerts billing invoice invoices payment payments security account accounts offer offers reward rewards customer care helpdesk noreply mail email info news online official department group company limited corp from your the and for bank insurance".split()
    own_words = lambda w: f"length({w}) >= 4 AND NOT {q.one_of(w, generic)}"
    unrelated = f"{q.any_of(q.split('name_words', ' '), own_words)} AND NOT {q.any_of(q.split('name_words', ' '), lambda w: f'{own_words(w)} AND {q.within(w, "sender_domain")}')}"
    claims_organisation = f"claim_id IS NULL AND (sender_brand IS NULL OR freemail) AND registrable <> '' AND NOT {q.one_of('registrable', PLATFORMS)} AND {q.match('name_words', f' ({ORGANISATION_MARKERS}) ')} AND {unrelated}"
    institution = f"freemail AND {q.match('name_words', f' ({INSTITUTIONAL_MARKERS}) ')}"
    role = q.match("name_words", f" ({'|'.join(ROLE_NAMES)}) ")
    title = q.match("concat(name_words, subject_words)", f" ({EXECUTIVE_TITLES}) ")
    owned_reply = "(reply_brand IS NOT NULL AND sender_brand IS NOT NULL AND reply_brand = sender_brand)"
    notice = q.match("name_words", " (settlement|claims|class action|administrator|trustee) ")
    # a fragment from the start of a long local part that comes back at least three times
    repeats = " OR ".join(f"length(local_part) - length(replace(local_part, substring(local_part, 1, {k}), '')) >= {3 * k}" for k in (2, 3, 4))
    scrambled = f"length(raw_local) - length({q.replace('raw_local', '[a-z][A-Z]', '')}) >= 8"
    return [
        Rule("identity.display_name_impersonation", "critical", 40, f"{stranger} AND freemail"),
        Rule("identity.display_name_impersonation", "high", 30, f"{stranger} AND NOT freemail AND NOT {notice}"),
        Rule("identity.brand_named_in_legal_notice", "medium", 15, f"{stranger} AND NOT freemail AND {notice}"),
        Rule("identity.unverified_brand_domain", "medium", 18, "core_brand IS NOT NULL AND sender_brand IS NULL"),
        Rule("identity.lookalike_sender_domain", "critical", 45, "near_id IS NOT NULL AND sender_brand IS NULL AND core_brand IS NULL"),
        Rule("identity.brand_domain_in_subdomain", "critical", 40, "label_brand IS NOT NULL AND sender_brand IS NULL"),
        Rule("identity.implausible_local_part", "medium", 16, f"length(local_part) >= 12 AND ({repeats})"),
        Rule("identity.randomised_address_case", "medium", 14, scrambled),
        Rule("identity.thread_lookalike_participant", "critical", 45, "party_confused"),
        Rule("identity.thread_lookalike_participant", "high", 32, "party_imitated AND NOT party_confused"),
        Rule("identity.reply_to_mismatch", "high", 26, f"{reply} AND NOT {owned_reply} AND reply_freemail AND NOT freemail"),
        Rule("identity.reply_to_mismatch", "medium", 16, f"{reply} AND NOT {owned_reply} AND NOT (reply_freemail AND NOT freemail)"),
        Rule("identity.sender_punycode_domain", "critical", 40, f"{q.match('sender_domain', r'(^|[.])xn--')} AND sender_mixed"),
        Rule("identity.sender_punycode_domain", "high", 24, f"{q.match('sender_domain', r'(^|[.])xn--')} AND NOT sender_mixed"),
        Rule("identity.sender_invisible_characters", "high", 24, q.match("concat(raw_name, ' ', raw_email)", HIDDEN)),
        Rule("identity.styled_display_name", "medium", 18, q.match("raw_name", STYLED)),
        Rule("identity.private_use_sender_tld", "medium", 14, f"sender_domain <> '' AND {q.one_of(tld, PRIVATE_TLDS)}"),
        Rule("identity.nonexistent_sender_tld", "high", 34, f"sender_domain LIKE '%.%' AND NOT {known} AND NOT {ip} AND NOT ({odd})"),
        Rule("identity.unparseable_sender", "low", 8, "has_sender AND sender_domain = ''"),
        Rule("identity.sender_ip_domain", "high", 28, ip),
        Rule("identity.malformed_sender_domain", "medium", 18, f"{odd} AND NOT {ip}"),
        Rule("identity.disposable_sender_domain", "high", 26, "disposable"),
        Rule("identity.sender_deep_subdomain", "low", 10, f"registrable <> '' AND {deep}"),
        Rule("identity.external_executive_claim", "high", 28, f"freemail AND {outside} AND NOT {q.one_of('recipient_registrable', FREEMAIL)} AND ({title} OR self_described)"),
        Rule("identity.unsupported_org_claim", "high", 26, f"{claims_organisation} AND {institution}"),
        Rule("identity.unsupported_org_claim", "medium", 18, f"{claims_organisation} AND NOT ({institution})"),
        Rule("identity.lookalike_of_recipient_domain", "critical", 45, f"{outside} AND length(sender_core) >= 5 AND length(recipient_core) >= 5 AND sender_core <> recipient_core AND ({confused} OR {close} = 1 OR ({close} = 2 AND length(sender_core) >= 10 AND length(recipient_core) >= 10))"),
        Rule("identity.own_department_from_outside", "medium", 16, f"{outside} AND length(recipient_core) >= 4 AND name_words LIKE concat('% ', recipient_core, ' %') AND {q.match('name_words', f' ({DEPARTMENTS}) ')}"),
        Rule("identity.own_domain_in_sender_name", "medium", 22, f"{outside} AND length(recipient_core) >= 4 AND name_words LIKE concat('% ', recipient_core, ' %')"),
        Rule("identity.alert_named_shared_item", "high", 30, f"{shared} AND {alerts} >= 2"),
        Rule("identity.alert_named_shared_item", "medium", 20, f"{shared} AND {alerts} = 1"),
        Rule("identity.thread_participant_name_reuse", "high", 30, f"name_reused AND NOT party_imitated AND NOT party_confused AND NOT {role}"),
    ]


def attachments(q: Dialect) -> list[Rule]:
    archive = q.overlap("extensions", ARCHIVE)
    locked = "locked"
    names = "array_join(filenames, '|')" if q.__class__.__name__ == "Spark" else "array_to_string(filenames, '|')"
    risky = q.overlap("extensions", [*EXECUTABLE, *DISK_IMAGE, *ARCHIVE, *MACRO, *SCRIPT_CONTAINER])
    size = "size(extensions)" if q.__class__.__name__ == "Spark" else "len(extensions)"
    newer = [x for x in MACRO if x.endswith("m")]
    return [
        Rule("attachment.executable", "critical", 40, q.overlap("extensions", EXECUTABLE)),
        Rule("attachment.disk_image", "high", 28, q.overlap("extensions", DISK_IMAGE)),
        Rule("attachment.archive", "high", 26, f"{archive} AND {locked}"),
        Rule("attachment.archive", "medium", 14, f"{archive} AND NOT {locked} AND (claim_id IS NOT NULL OR freemail)"),
        Rule("attachment.archive", "low", 8, f"{archive} AND NOT {locked} AND NOT (claim_id IS NOT NULL OR freemail)"),
        Rule("attachment.macro_capable", "high", 24, q.overlap("extensions", newer)),
        Rule("attachment.macro_capable", "low", 8, f"{q.overlap('extensions', [x for x in MACRO if x not in newer])} AND NOT {q.overlap('extensions', newer)}"),
        Rule("attachment.script_container", "high", 26, q.overlap("extensions", SCRIPT_CONTAINER)),
        Rule("attachment.double_extension", "critical", 40, f"{q.overlap('extensions', EXECUTABLE + SCRIPT_CONTAINER)} AND {q.overlap('inner_extensions', DECOY)}"),
        Rule("attachment.filename_direction_override", "critical", 40, q.match(names, BIDI)),
        Rule("attachment.filename_hidden_characters", "medium", 16, f"{q.match(names, HIDDEN)} AND NOT {q.match(names, BIDI)}"),
        Rule("attachment.none_suspicious", "info", 0, f"{size} > 0 AND NOT {risky}"),
    ]


def language_flag(q: Dialect, language: str) -> str:
    """At least three different markers among the first words; Hindi by its script."""
    window = q.head("text_words", BOUNDS.language_window)
    if language == "hi":
        letters = q.replace(window, r"[^\x{0900}-\x{097F}]", "")
        return f"length({letters}) >= 0.12 * length({window})"
    return f"{q.common(window, LANGUAGE_MARKERS[language])} >= 3"


def language_flags(q: Dialect) -> dict[str, str]:
    return {f"is_{k.replace('-', '_')}": language_flag(q, k) for k in [*LANGUAGE_MARKERS, "hi"]}


def asserted(q: Dialect, pattern: str) -> str:
    """Whether a request stands in a sentence that does not deny it; a condition before a denial keeps the request."""
    denied = DENIED[:-1] + "( .*)?" + pattern
    return f"({q.match('text_words', pattern)} AND {q.any_of(q.split('said', '[.]'), lambda s: f'{q.match(s, pattern)} AND (NOT {q.match(s, denied)} OR {q.match(s, CONDITIONAL)})')})"


def text_columns(q: Dialect) -> dict[str, str]:
    """What the rules want to know of a text, as flags, so that the text itself goes no further: ``h_<theme>``, whether
    enough of a theme's patterns match, English ones always, others where their language is likely; and wording of
    single rules."""
    out = {
        "greets_generally": q.match("body_words", GENERIC_GREETING),
        "vouches": q.match("body_words", FORGED_ASSURANCE),
        "pretext": q.match("text_words", PRETEXT),
        "locked": q.match("text_words", " (archive|zip|file|attachment) ( ?[^ ]+ ){0,6}?password "),
        "leaves_list": q.match("text_words", UNSUBSCRIBE),
        "asks": q.match("text_words", THEMES["credential_verification"][4]["en"][0]),
        "self_described": f"({q.match('substring(body_words, 1, 500)', f' (i am|this is|as) (the |your )?({EXECUTIVE_TITLES}) ')} OR {q.match('substring(body_words, greatest(length(body_words) - 199, 1))', f' ({EXECUTIVE_TITLES}) $')})",
    }
    delivered = f"({q.match('subject_words', DELIVERED)} OR {q.match('body_words', DELIVERED)})"  # a code beside its word
    for theme, (_, _, least, bulk, by_language) in THEMES.items():
        hits = []
        for language, patterns in by_language.items():
            gate = "" if language == "en" else f"is_{language.replace('-', '_')} AND "
            hits += [f"CASE WHEN {gate}{asserted(q, p) if theme in DENIABLE else q.match('text_words', p)} THEN 1 ELSE 0 END" for p in patterns]
        if theme == "mfa_request":
            hits.append(f"CASE WHEN {asserted(q, ENTERED)} AND NOT {delivered} THEN 1 ELSE 0 END")
        out[f"h_{theme}"] = f"({' + '.join(hits)}) >= {least}"
    return out


def theme_columns() -> dict[str, str]:
    """``t_<theme>``: the themes that survive in bulk mail; a demand with a wallet's address does."""
    kept = {"crypto_demand": "(NOT bulk OR wallet)"}
    return {f"t_{theme}": f"h_{theme}" + (f" AND {kept.get(theme, 'NOT bulk')}" if bulk else "") for theme, (_, _, _, bulk, _) in THEMES.items()}


def bulk_flag() -> str:
    """Unsubscribe wording with many links or an unsubscribe link, no request for credentials, little hidden text."""
    return f"(leaves_list AND (web_links >= {BOUNDS.bulk_links} OR unsubscribe_links > 0) AND NOT asks AND hidden_chars < {BOUNDS.hidden_chars})"


def content(q: Dialect) -> list[Rule]:
    themes = [Rule(f"content.{k}", sev, score, f"t_{k}") for k, (sev, score, *_) in THEMES.items()]
    combos = [Rule(f"content.combo.{k}", sev, score, " AND ".join(f"t_{t}" for t in needs)) for k, (needs, sev, score) in COMBINATIONS.items()]
    letters = q.replace("raw_subject", "[^A-Za-z]", "")
    capitals = q.replace("raw_subject", "[^A-Z]", "")
    signs = " + ".join([
        f"CASE WHEN length({letters}) >= 15 AND length({capitals}) >= 0.6 * length({letters}) THEN 1 ELSE 0 END",
        f"CASE WHEN {q.match('raw_subject', '(!{3,}|[?]{3,}|[*]{3,}|[#]{3,}|[$]{2,})')} THEN 1 ELSE 0 END",
        f"CASE WHEN {q.match('raw_subject', '[A-Z]{2,}-?[0-9]{4,}')} THEN 1 ELSE 0 END",
        f"CASE WHEN {q.match('raw_subject', STYLED)} THEN 1 ELSE 0 END",
    ])
    return [
        *themes,
        *combos,
        Rule("content.generic_salutation_with_brand_claim", "low", 10, "claim_id IS NOT NULL AND greets_generally"),
        Rule("content.subject_obfuscation", "medium", 14, f"length(raw_subject) >= 20 AND ({signs}) >= 3"),
        Rule("content.subject_obfuscation", "low", 8, f"length(raw_subject) >= 20 AND ({signs}) = 2"),
        Rule("content.subject_padding", "medium", 12, q.match("raw_subject", " {24,}")),
        Rule("content.forged_trust_assurance", "medium", 22, "vouches"),
        Rule("content.hidden_body_text", "medium", 22, f"hidden_chars >= {BOUNDS.hidden_chars}"),
        Rule("link.echoed_form_link", "medium", 22, "form_lines >= 3 AND echoes_reader AND long_form_value AND strange_links > 0"),
        Rule("link.link_only_body", "medium", 25, f"body_chars < 140 AND foreign_links > 0 AND {q.match('subject_words', ACTION_SUBJECT)}"),
        Rule("link.link_only_body", "low", 10, f"body_chars < 140 AND foreign_links > 0 AND NOT {q.match('subject_words', ACTION_SUBJECT)}"),
    ]


def links(q: Dialect) -> list[Rule]:
    judged = "web AND host_registrable <> '' AND NOT tracker"
    own = "(proven AND host_registrable = registrable)"
    signs_in = q.match("lower(concat(anchor, ' ', path))", SIGN_IN_WORDING)
    # an anchor that reads as an address, against where the link ends
    differs = f"{judged} AND shown_registrable <> '' AND shown_registrable <> host_registrable AND NOT (shown_brand IS NOT NULL AND owner_brand IS NOT NULL AND owner_brand = shown_brand)"
    opaque_path = f"NOT {q.within('shown_registrable', 'host')} AND NOT {q.match('lower(path)', SIGN_IN_WORDING)}"
    excused = f"shown_brand IS NULL AND (host_registrable = registrable OR (shown_registrable = registrable AND proven AND NOT freemail AND {opaque_path}))"
    vetted = f"shown_brand IS NULL AND {q.match('shown_host', '[.](gov|mil)$')} AND {q.match('host', '[.](gov|mil)$')}"
    service = f"shown_brand IS NULL AND shown_registrable <> recipient_registrable AND NOT {q.match('subject_words', SIGN_IN_WORDING)} AND proven AND NOT freemail AND NOT open_hosting AND hops = 0 AND {opaque_path} AND length(path) > 1"
    own_service = "shown_brand IS NOT NULL AND host_registrable = registrable AND proven AND sender_brand IS NOT NULL AND sender_brand <> shown_brand AND (claim_id IS NULL OR claim_id <> shown_brand)"
    milder = f"(({vetted}) OR ({service}) OR ({own_service}))"
    ends = f"hop = hops AND {differs} AND NOT ({excused})"
    acts = q.match("anchor_words", f" {ACTION_WORDING}[^ ]* ")
    names = f"{judged} AND anchor_brand IS NOT NULL AND (owner_brand IS NULL OR owner_brand <> anchor_brand) AND NOT (host_registrable = registrable AND proven) AND shown_registrable = ''"
    bare = f"proven AND NOT {acts}"
    long_anchor = f"length(anchor_words) - length(replace(anchor_words, ' ', '')) > 4 AND (claim_id IS NULL OR claim_id <> anchor_brand) AND NOT {acts}"
    number = r"(0x[0-9a-f]{1,8}|[0-9]{8,10})"
    ip = f"({q.match('host', IPV4)} OR {q.match('host', rf'^{number}$')} OR {q.match('host', r'^\[[0-9a-f.]*$')})"
    private = f"({q.match('host', PRIVATE_IPV4)} OR {q.match('lower(address)', r'//\[(::1|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)')})"
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    named_ip = q.match("host", rf"(^|[.-]){octet}-{octet}-{octet}-{octet}[.-]")
    document = q.match("path", r"(?i)\.(html?|php|aspx?)$")
    file_name = q.match("lower(anchor)", r"^\s*[^\s/]+\.(pdf|docx?|xlsx?|pptx?|zip|csv|txt)\s*$")
    return [
        Rule("link.displayed_url_mismatch", "critical", 45, f"{ends} AND shown_brand IS NOT NULL AND NOT {milder}"),
        Rule("link.displayed_url_mismatch", "high", 32, f"{ends} AND shown_brand IS NULL AND NOT {milder}"),
        Rule("link.displayed_url_mismatch", "medium", 16, f"{ends} AND {milder}"),
        Rule("link.displayed_url_mismatch", "high", 32, f"hop < hops AND {differs} AND shown_brand IS NOT NULL AND end_registrable = shown_registrable AND host_registrable <> registrable"),
        Rule("link.anchor_brand_mismatch", "high", 28, f"{names} AND NOT ({bare}) AND NOT ({long_anchor})"),
        Rule("link.anchor_brand_mismatch", "medium", 14, f"{names} AND {bare} AND NOT ({long_anchor})"),
        Rule("link.private_ip_url", "low", 8, f"web AND {ip} AND {private}", 1),
        Rule("link.ip_address_url", "critical", 40, f"web AND {ip} AND NOT {private}", 1),
        Rule("link.ip_named_host", "medium", 16, f"{judged} AND NOT {ip} AND {named_ip} AND host_registrable <> registrable"),
        Rule("link.punycode_domain", "critical", 40, f"web AND {q.match('host', r'(^|[.])xn--')} AND (host_mixed OR (host_near IS NOT NULL AND owner_brand IS NULL))"),
        Rule("link.punycode_domain", "medium", 18, f"web AND {q.match('host', r'(^|[.])xn--')} AND NOT (host_mixed OR (host_near IS NOT NULL AND owner_brand IS NULL))"),
        Rule("link.lookalike_domain", "critical", 40, f"{judged} AND host_near IS NOT NULL AND owner_brand IS NULL"),
        Rule("link.misleading_domain", "critical", 42, f"{judged} AND label_brand IS NOT NULL AND (owner_brand IS NULL OR owner_brand <> label_brand)"),
        Rule("link.url_shortener", "low", 10, "web AND shortener", 1),
        Rule("link.opaque_redirect", "medium", 20, f"{judged} AND opaque AND hop = hops AND host_registrable <> registrable"),
        Rule("link.redirect_chain", "medium", 18, f"{judged} AND hop < hops AND end_registrable <> '' AND end_registrable <> host_registrable AND host_registrable <> registrable"),
        Rule("link.insecure_login", "high", 26, f"scheme = 'http' AND {signs_in}"),
        Rule("link.insecure_http", "low", 8, f"scheme = 'http' AND NOT {signs_in}"),
        Rule("link.ftp_link", "medium", 18, "scheme IN ('ftp', 'sftp')", 1),
        Rule("link.local_file_link", "low", 8, "scheme = 'file'", 1),
        Rule("link.dangerous_scheme", "critical", 45, q.one_of("scheme", [s for s in DANGEROUS_SCHEMES if s != "file"]), 1),
        Rule("link.malformed_url", "low", 10, "hop = 0 AND url <> '' AND scheme IN ('http', 'https', '') AND host = '' AND shown_host <> url", 1),
        Rule("link.excessive_subdomains", "medium", 16, f"{judged} AND subdomain_labels > 4", 1),
        Rule("link.credential_link_unrelated_domain", "high", 30, f"{judged} AND {signs_in} AND NOT open_hosting AND claim_id IS NOT NULL AND owner_brand IS NULL AND host_registrable <> claim_domain"),
        Rule("link.credential_link_open_hosting", "high", 26, f"{judged} AND {signs_in} AND open_hosting"),
        Rule("link.page_in_open_storage", "medium", 16, f"{judged} AND open_hosting AND {document} AND NOT {signs_in}"),
        Rule("link.filename_lookalike_tld", "medium", 16, f"{judged} AND {q.match('host', r'[.](zip|mov)$')}", 1),
        Rule("link.fake_attachment", "high", 26, f"{judged} AND {file_name} AND host_registrable <> registrable", 1),
    ]


def message_rules(q: Dialect) -> list[Rule]:
    return [*authentication(q), *identity(q), *attachments(q), *content(q)]


#: Ids that a correlation joins.
MONEY = [f"content.{t}" for t in ("wire_transfer", "payment_detail_change", "payroll_change", "gift_card", "invoice_fraud")]
IMPERSONATION = ["identity.display_name_impersonation", "identity.brand_domain_in_subdomain", "identity.thread_lookalike_participant", "identity.lookalike_sender_domain", "identity.sender_punycode_domain", "identity.thread_participant_name_reuse", "identity.lookalike_of_recipient_domain", "link.lookalike_domain", "link.misleading_domain", "link.displayed_url_mismatch"]
CREDENTIAL = ["content.credential_verification", "link.credential_link_unrelated_domain", "link.credential_link_open_hosting"]
DANGEROUS_FILES = ["attachment.executable", "attachment.disk_image", "attachment.script_container", "attachment.double_extension", "attachment.macro_capable"]
PRETEXT = " (invoice|receipt|statement|document|report|order|contract|scan|payment) "
#: Identity findings that can be made of a sender line alone.
TRIAGE = [f"identity.{x}" for x in (
    "display_name_impersonation", "lookalike_sender_domain", "lookalike_of_recipient_domain", "sender_punycode_domain", "sender_invisible_characters", "styled_display_name", "nonexistent_sender_tld", "private_use_sender_tld", "unparseable_sender", "sender_ip_domain",
    "malformed_sender_domain", "brand_domain_in_subdomain", "disposable_sender_domain", "sender_deep_subdomain", "unsupported_org_claim", "implausible_local_part", "randomised_address_case", "unverified_brand_domain", "brand_named_in_legal_notice", "own_domain_in_sender_name", "own_department_from_outside",
)]
#: Link findings that weigh more where the message asks for a sign-in: id -> severity and score.
ASKED = {"link.url_shortener": ("medium", 20), "link.page_in_open_storage": ("high", 26)}
