"""Policy profiles as data, lowered to expressions: risk, verdict, reasons and plan of a row."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.spans import let
from hushframe.operators.transform import OPERATIONS

VERDICTS = ("ALLOW", "SANITIZE", "ASK", "BLOCK")
TRUST = ("LOCAL", "INTERNAL_TRUSTED", "EXTERNAL_APPROVED", "EXTERNAL_UNKNOWN", "EXTERNAL_BLOCKED")
PURPOSES = ("TREATMENT", "RESEARCH", "EDUCATION", "OPERATIONS", "PUBLICATION", "EXTERNAL_AI_ASSISTANCE", "UNKNOWN")
CONTEXT_ONLY = ("MEDICAL_CONTENT", "SEX", "RARE_CONTEXT")
#: Risk of a type that no profile declares.
UNDECLARED_RISK = 25

# The stable reason code of each fact type.
REASONS = {
    "PHONE": "CONTACT_IDENTIFIER_PRESENT", "LANDLINE": "CONTACT_IDENTIFIER_PRESENT", "EMAIL": "CONTACT_IDENTIFIER_PRESENT", "SOCIAL_MEDIA_ID": "CONTACT_IDENTIFIER_PRESENT",
    "URL": "NETWORK_IDENTIFIER_PRESENT", "IP_ADDRESS": "NETWORK_IDENTIFIER_PRESENT",
    "PERSON_NAME": "DIRECT_IDENTIFIER_PRESENT", "DOCTOR_NAME": "DIRECT_IDENTIFIER_PRESENT", "NURSE_NAME": "DIRECT_IDENTIFIER_PRESENT", "RELATIVE_NAME": "DIRECT_IDENTIFIER_PRESENT",
    "HOSPITAL_NAME": "DIRECT_IDENTIFIER_PRESENT", "DEPARTMENT": "DIRECT_IDENTIFIER_PRESENT", "WARD": "DIRECT_IDENTIFIER_PRESENT", "BED_NUMBER": "DIRECT_IDENTIFIER_PRESENT",
    "GOVERNMENT_ID": "GOVERNMENT_ID_PRESENT",
    "MEDICAL_RECORD_NUMBER": "MEDICAL_RECORD_IDENTIFIER_PRESENT", "SPECIMEN_ID": "MEDICAL_RECORD_IDENTIFIER_PRESENT", "ACCESSION_NUMBER": "MEDICAL_RECORD_IDENTIFIER_PRESENT",
    "EXACT_DATE": "EXACT_DATE_PRESENT", "PRECISE_LOCATION": "PRECISE_LOCATION_PRESENT", "POSTAL_CODE": "PRECISE_LOCATION_PRESENT",
    "AGE": "QUASI_IDENTIFIER_COMBINATION", "SEX": "QUASI_IDENTIFIER_COMBINATION",
    "BIOMETRIC": "BIOMETRIC_DATA_PRESENT", "GENETIC": "GENETIC_DATA_PRESENT", "MEDICAL_CONTENT": "MEDICAL_CONTENT_PRESENT",
    "RARE_CONDITION": "RARE_CONDITION_REIDENTIFICATION_RISK", "RARE_CONTEXT": "RARE_CONDITION_REIDENTIFICATION_RISK",
    "PARSER_FAILURE": "PARSER_FAILURE", "UNSUPPORTED_FORMAT": "UNSUPPORTED_FORMAT",
}


@dataclass(frozen=True)
class HardRule:
    reasons: tuple[str, ...]
    types: tuple[str, ...] = ()  # all of them must be present; none matches anything
    trust: tuple[str, ...] = ()  # none matches anyone
    verdict: str = "BLOCK"


@dataclass(frozen=True)
class Profile:
    name: str
    identifiers: dict[str, tuple[str, int]]  # type -> (action, risk)
    medical: dict[str, int]
    recipient_risk: dict[str, int]
    purpose_risk: dict[str, int]
    hard: tuple[HardRule, ...]
    version: str = "1"
    thresholds: dict[str, int] = field(default_factory=lambda: {"allow_max": 0, "sanitize_max": 60})
    verification: dict[str, object] = field(default_factory=lambda: {"required": True, "fail_verdict": "BLOCK"})

    def __post_init__(self) -> None:
        def score(x: object) -> bool:
            return isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 100

        wrong = []
        if not self.name or not self.version:
            wrong.append("name and version must not be empty")
        if bad := [t for t, (action, risk) in self.identifiers.items() if action not in (*OPERATIONS, "BLOCK") or not score(risk)]:
            wrong.append(f"identifiers {bad}: action or risk")
        if bad := [t for t, risk in self.medical.items() if not score(risk)]:
            wrong.append(f"medical {bad}: risk")
        if set(self.identifiers) & set(self.medical):
            wrong.append("a type is both identifier and medical")
        if set(self.recipient_risk) != set(TRUST) or not all(map(score, self.recipient_risk.values())):
            wrong.append("recipient_risk must name each trust level")
        if set(self.purpose_risk) != set(PURPOSES) or not all(map(score, self.purpose_risk.values())):
            wrong.append("purpose_risk must name each purpose")
        if set(self.thresholds) != {"allow_max", "sanitize_max"} or not all(map(score, self.thresholds.values())) or self.thresholds["allow_max"] > self.thresholds["sanitize_max"]:
            wrong.append("thresholds")
        if self.verification != {"required": True, "fail_verdict": "BLOCK"}:
            wrong.append("verification must be required and block")
        if any(r.verdict not in VERDICTS or not r.reasons or set(r.trust) - set(TRUST) for r in self.hard):
            wrong.append("hard rules")
        if wrong:
            raise ValueError(f"profile {self.name!r}: " + "; ".join(wrong))

    @property
    def id(self) -> str:
        return f"{self.name}/{self.version}"

    def action(self, type_: str) -> str | None:
        return self.identifiers[type_][0] if type_ in self.identifiers else None


def from_mapping(tree: dict) -> Profile:
    """A profile from a parsed YAML or JSON tree; unknown keys are refused."""

    def closed(x: dict, *keys: str) -> dict:
        if not isinstance(x, dict) or set(x) - set(keys):
            raise ValueError(f"unknown keys {sorted(set(x) - set(keys))}" if isinstance(x, dict) else "mapping expected")
        return x

    closed(tree, "profile", "version", "rules", "recipient_risk", "purpose_risk", "thresholds", "verification")
    rules = closed(tree["rules"], "hard", "identifiers", "medical")
    hard = []
    for r in rules.get("hard", ()):
        closed(r, "condition", "verdict", "reason_code", "reason_codes")
        if ("reason_code" in r) == ("reason_codes" in r):
            raise ValueError("exactly one of reason_code and reason_codes")
        when = closed(r.get("condition", {}), "facts_contain", "recipient_trust_level")
        hard.append(HardRule(tuple(r.get("reason_codes") or [r["reason_code"]]), tuple(when.get("facts_contain", ())), tuple(when.get("recipient_trust_level", ())), r["verdict"]))
    ids = {t: (closed(x, "action", "risk_score")["action"], x["risk_score"]) for t, x in rules["identifiers"].items()}
    medical = {t: closed(x, "risk_score")["risk_score"] for t, x in rules.get("medical", {}).items()}
    return Profile(tree["profile"], ids, medical, tree["recipient_risk"], tree["purpose_risk"], tuple(hard), str(tree["version"]), tree["thresholds"], tree["verification"])


# Actions and scores of the bundled profiles.
_STRICT = Profile(
    name="external-ai-strict",
    identifiers={
        "PHONE": ("REMOVE", 20), "EMAIL": ("REMOVE", 20), "URL": ("REMOVE", 15), "IP_ADDRESS": ("REMOVE", 15), "PERSON_NAME": ("TOKENIZE", 20), "GOVERNMENT_ID": ("REMOVE", 40),
        "MEDICAL_RECORD_NUMBER": ("REMOVE", 25), "EXACT_DATE": ("GENERALIZE", 15), "PRECISE_LOCATION": ("GENERALIZE", 15), "BIOMETRIC": ("BLOCK", 50), "GENETIC": ("BLOCK", 50),
        "AGE": ("GENERALIZE", 10), "HOSPITAL_NAME": ("GENERALIZE", 20), "DEPARTMENT": ("GENERALIZE", 15), "WARD": ("GENERALIZE", 20), "BED_NUMBER": ("REMOVE", 20),
        "DOCTOR_NAME": ("TOKENIZE", 20), "NURSE_NAME": ("TOKENIZE", 20), "RELATIVE_NAME": ("TOKENIZE", 25), "SPECIMEN_ID": ("REMOVE", 25), "ACCESSION_NUMBER": ("REMOVE", 25),
        "LANDLINE": ("REMOVE", 20), "POSTAL_CODE": ("REMOVE", 20), "SOCIAL_MEDIA_ID": ("REMOVE", 25),
    },
    medical={"MEDICAL_CONTENT": 10, "RARE_CONDITION": 20, "RARE_CONTEXT": 30, "SEX": 5},
    recipient_risk={"LOCAL": 0, "INTERNAL_TRUSTED": 0, "EXTERNAL_APPROVED": 10, "EXTERNAL_UNKNOWN": 20, "EXTERNAL_BLOCKED": 100},
    purpose_risk={"TREATMENT": 0, "RESEARCH": 5, "EDUCATION": 5, "OPERATIONS": 0, "PUBLICATION": 10, "EXTERNAL_AI_ASSISTANCE": 15, "UNKNOWN": 30},
    hard=(
        HardRule(("UNTRUSTED_RECIPIENT",), trust=("EXTERNAL_BLOCKED",)),
        HardRule(("GOVERNMENT_ID_PRESENT",), ("GOVERNMENT_ID",), ("EXTERNAL_UNKNOWN", "EXTERNAL_BLOCKED")),
        HardRule(("BIOMETRIC_DATA_PRESENT",), ("BIOMETRIC", "GENETIC"), ("EXTERNAL_UNKNOWN", "EXTERNAL_BLOCKED", "EXTERNAL_APPROVED")),
        HardRule(("PARSER_FAILURE",), ("PARSER_FAILURE",)),
        HardRule(("UNSUPPORTED_FORMAT",), ("UNSUPPORTED_FORMAT",)),
    ),
)
_BLOCKED = ("EXTERNAL_BLOCKED",)
_RESEARCH = replace(
    _STRICT, name="research",
    identifiers=_STRICT.identifiers | {
        "EXACT_DATE": ("DATE_SHIFT", 10), "AGE": ("GENERALIZE", 8), "HOSPITAL_NAME": ("GENERALIZE", 15), "DEPARTMENT": ("GENERALIZE", 12), "WARD": ("GENERALIZE", 15), "BED_NUMBER": ("REMOVE", 15),
        "DOCTOR_NAME": ("TOKENIZE", 15), "NURSE_NAME": ("TOKENIZE", 15), "RELATIVE_NAME": ("TOKENIZE", 20), "SPECIMEN_ID": ("TOKENIZE", 20), "ACCESSION_NUMBER": ("TOKENIZE", 20),
        "LANDLINE": ("REMOVE", 15), "POSTAL_CODE": ("REMOVE", 15), "SOCIAL_MEDIA_ID": ("REMOVE", 20),
    },
    medical={"MEDICAL_CONTENT": 5, "RARE_CONDITION": 30, "RARE_CONTEXT": 35, "SEX": 5},
    recipient_risk=_STRICT.recipient_risk | {"EXTERNAL_APPROVED": 5, "EXTERNAL_UNKNOWN": 15},
    purpose_risk=_STRICT.purpose_risk | {"RESEARCH": 0, "OPERATIONS": 5, "PUBLICATION": 15},
    hard=(_STRICT.hard[0], replace(_STRICT.hard[1], trust=_BLOCKED), replace(_STRICT.hard[2], trust=_BLOCKED), *_STRICT.hard[3:]),
    thresholds={"allow_max": 10, "sanitize_max": 70},
)
_TEACHING = replace(
    _STRICT, name="teaching-demo",
    medical=_STRICT.medical | {"RARE_CONDITION": 25},
    purpose_risk=_STRICT.purpose_risk | {"TREATMENT": 5, "EDUCATION": 0, "OPERATIONS": 5, "PUBLICATION": 15},
)
PROFILES: dict[str, Profile] = {p.name: p for p in (_STRICT, _RESEARCH, _TEACHING)}


def coerce_trust(x: Column) -> Column:
    name = F.upper(F.replace(F.trim(x), F.lit("-"), F.lit("_")))
    return F.when(name.isin(*TRUST), name).otherwise("EXTERNAL_UNKNOWN")


def coerce_purpose(x: Column) -> Column:
    name = F.upper(F.replace(F.trim(x), F.lit("-"), F.lit("_")))
    return F.when(name.isin(*PURPOSES), name).otherwise("UNKNOWN")


def _map(table: dict[str, object]) -> Column:
    text = ", ".join(f"'{k}', '{v}'" if isinstance(v, str) else f"'{k}', {v}" for k, v in table.items())
    return F.expr(f"map({text})")


def _codes(*codes: str) -> Column:
    return F.expr(f"array({', '.join(repr(c) for c in codes)})") if codes else F.array().cast("array<string>")


def types_of(facts: Column) -> Column:
    return F.array_distinct(F.transform(facts, lambda f: f["type"]))


def risk_score(types: Column, trust: Column, purpose: Column, profile: Profile) -> Column:
    """Sum over distinct types, plus what recipient and purpose add."""
    risks = _map({t: r for t, (_, r) in profile.identifiers.items()} | profile.medical)
    base = F.aggregate(types, F.lit(0), lambda acc, t: acc + F.coalesce(F.try_element_at(risks, t), F.lit(UNDECLARED_RISK)))
    return base + F.try_element_at(_map(profile.recipient_risk), trust) + F.try_element_at(_map(profile.purpose_risk), purpose)


def risk_level(score: Column) -> Column:
    return F.when(score <= 20, "LOW").when(score <= 50, "MEDIUM").when(score <= 80, "HIGH").otherwise("CRITICAL")


PLAN = "array<struct<op:string,target:string>>"


def plan_of(types: Column, profile: Profile) -> Column:
    """One operation per distinct type in order of appearance; types without action, or to be blocked, give none."""
    actions = _map({t: a for t, (a, _) in profile.identifiers.items() if a != "BLOCK"})
    ops = F.transform(types, lambda t: F.struct(F.try_element_at(actions, t).alias("op"), t.alias("target")))
    return F.filter(ops, lambda o: o["op"].isNotNull()).cast(PLAN)


def granted_plan(facts: Column, profile: Profile) -> Column:
    """What an approved request still rewrites: all but the values that cannot be; empty, not null, if that is nothing."""
    return plan_of(types_of(F.filter(facts, lambda f: ~f["read_only"])), profile)


def decide(facts: Column, trust: Column, purpose: Column, profile: Profile) -> Column:
    """struct<verdict,reason_codes,explanation,risk_level,risk_score,plan,policy_version>: the ordered cascade.

    Hard rules, nothing found, types to block, undeclared types, read-only values,
    unknown purpose, rare context outside, medical content to unknown recipients,
    a plan, context only; whatever is left is blocked.  The score never decides.
    """
    reason = _map(REASONS)
    no_plan = F.lit(None).cast(PLAN)
    external = trust.isin("EXTERNAL_APPROVED", "EXTERNAL_UNKNOWN", "EXTERNAL_BLOCKED")
    blocked = [t for t, (a, _) in profile.identifiers.items() if a == "BLOCK"]
    declared = [*profile.identifiers, *profile.medical]

    def of(types: Column) -> Column:
        score = risk_score(types, trust, purpose, profile)

        def out(verdict: str, codes: Column, why: Column | str, plan: Column = no_plan) -> Column:
            return F.struct(
                F.lit(verdict).alias("verdict"), codes.cast("array<string>").alias("reason_codes"), (F.lit(why) if isinstance(why, str) else why).alias("explanation"),
                risk_level(score).alias("risk_level"), score.alias("risk_score"), plan.alias("plan"), F.lit(profile.id).alias("policy_version"),
            )

        known = F.array_distinct(F.filter(F.transform(types, lambda t: F.try_element_at(reason, t)), lambda c: c.isNotNull()))
        has = lambda *names: F.exists(types, lambda t: t.isin(*names))
        plan = plan_of(types, profile)
        chain = None
        for rule in profile.hard:
            when = F.lit(True)
            if rule.types:
                when = when & (F.size(F.array_except(_codes(*rule.types), types)) == 0)
            if rule.trust:
                when = when & trust.isin(*rule.trust)
            result = out(rule.verdict, _codes(*dict.fromkeys(rule.reasons)), "a hard rule applies")
            chain = F.when(when, result) if chain is None else chain.when(when, result)
        cases = [
            (F.size(types) == 0, out("ALLOW", _codes("NO_SENSITIVE_DATA_DETECTED"), "nothing sensitive was found")),
            (has(*blocked) if blocked else F.lit(False), out("BLOCK", F.array_distinct(F.transform(F.filter(types, lambda t: t.isin(*blocked)), lambda t: F.coalesce(F.try_element_at(reason, t), F.lit("RISK_THRESHOLD_EXCEEDED")))), "a type that must not be released was found")),
            (F.exists(types, lambda t: ~t.isin(*declared)), out("BLOCK", _codes("TRANSFORMATION_INCOMPLETE"), "a type that the profile does not declare was found")),
            (F.exists(facts, lambda f: f["read_only"] & ~f["type"].isin(*CONTEXT_ONLY)), out("ASK", _codes("UNTRANSFORMABLE_IDENTIFIER", "CONSENT_REQUIRED"), "an identifier lies in a value that cannot be rewritten")),
            (purpose == "UNKNOWN", out("ASK", _codes("PURPOSE_NOT_DECLARED", "CONSENT_UNKNOWN"), "the purpose is unknown")),
            (has("RARE_CONDITION", "RARE_CONTEXT") & trust.isin("EXTERNAL_UNKNOWN", "EXTERNAL_APPROVED"), out("ASK", _codes("RARE_CONDITION_REIDENTIFICATION_RISK", "CONSENT_REQUIRED"), "a rare context may identify by itself")),
            (has("MEDICAL_CONTENT") & (trust == "EXTERNAL_UNKNOWN"), out("ASK", _codes("MEDICAL_CONTENT_PRESENT", "UNKNOWN_RECIPIENT", "CONSENT_REQUIRED"), "medical content for an unknown recipient")),
            (F.size(plan) > 0, out("SANITIZE", F.when(external, F.array_distinct(F.concat(known, _codes("EXTERNAL_RECIPIENT")))).otherwise(known), "a plan is ready and must be verified", plan)),
            (F.forall(types, lambda t: t.isin(*CONTEXT_ONLY)), out("ALLOW", F.when(F.size(known) > 0, known).otherwise(_codes("MEDICAL_CONTENT_PRESENT")), "only context that no rewriting removes")),
        ]
        for when, result in cases:
            chain = F.when(when, result) if chain is None else chain.when(when, result)
        return chain.otherwise(out("BLOCK", _codes("TRANSFORMATION_INCOMPLETE"), "something sensitive has no transformation"))

    return let(types_of(facts), of)


def closed_decision(profile: Profile, code: str = "UNSUPPORTED_FORMAT") -> Column:
    """What unreadable payloads get."""
    return F.struct(
        F.lit("BLOCK").alias("verdict"), _codes(code).alias("reason_codes"), F.lit("the payload cannot be read").alias("explanation"),
        F.lit("CRITICAL").alias("risk_level"), F.lit(100).alias("risk_score"), F.lit(None).cast(PLAN).alias("plan"), F.lit(profile.id).alias("policy_version"),
    )
