"""The pattern catalog and other literal tables."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """A detection pattern in Python syntax; ``flag`` is "i" for any case."""

    id: str
    category: str
    severity: str
    flag: str
    regex: str
    description: str = ""


# The detection patterns, in scan order.
PATTERNS: tuple[Pattern, ...] = (
    Pattern("role_system", "role_marker", "high", "i", r"^SYSTEM:\s*"),
    Pattern("role_assistant", "role_marker", "high", "i", r"^ASSISTANT:\s*"),
    Pattern("role_user", "role_marker", "medium", "i", r"^USER:\s*"),
    Pattern("role_developer", "role_marker", "high", "i", r"^DEVELOPER:\s*"),
    Pattern("role_admin", "role_marker", "high", "i", r"^ADMIN(?:ISTRATOR)?:\s*"),
    Pattern("role_instruction", "role_marker", "high", "i", r"^INSTRUCTIONS?:\s*"),
    Pattern("role_human", "role_marker", "medium", "i", r"^HUMAN:\s*"),
    Pattern("role_ai", "role_marker", "medium", "i", r"^AI:\s*"),
    Pattern("role_system_bracket", "role_marker", "high", "i", r"^\[SYSTEM\]"),
    Pattern("role_inst_bracket", "role_marker", "high", "i", r"^\[INST\]"),
    Pattern("role_system_xml", "role_marker", "high", "i", r"<system>"),
    Pattern("role_assistant_xml", "role_marker", "medium", "i", r"<assistant>"),
    Pattern("ignore_previous", "instruction_override", "high", "i", r"ignore\s+(?:all\s+)?(?:previous|prior|earlier|above)\s+(?:instructions?|prompts?|rules?|guidelines?|directions?)"),
    Pattern("forget_previous", "instruction_override", "high", "i", r"forget\s+(?:all\s+)?(?:(?:previous|prior|earlier|above)\s+)?(?:instructions?|prompts?|rules?|context|guidelines?)"),
    Pattern("disregard_previous", "instruction_override", "high", "i", r"disregard\s+(?:all\s+)?(?:previous|prior|earlier|above)\s+(?:instructions?|prompts?|rules?)"),
    Pattern("override_instructions", "instruction_override", "high", "i", r"override\s+(?:the\s+)?(?:system\s+)?(?:prompt|instructions?|rules?|guidelines?)"),
    Pattern("new_instructions", "instruction_override", "high", "i", r"new\s+instructions?:\s*"),
    Pattern("updated_instructions", "instruction_override", "high", "i", r"(?:updated?|revised?|changed?)\s+instructions?:\s*"),
    Pattern("stop_being", "instruction_override", "medium", "i", r"stop\s+being\s+(?:a\s+)?(?:helpful|assistant|ai|chatbot)"),
    Pattern("from_now_on", "instruction_override", "medium", "i", r"from\s+now\s+on,?\s+(?:you\s+)?(?:will|must|should|are)"),
    Pattern("you_are_now", "role_assumption", "high", "i", r"you\s+are\s+now\s+(?:a\s+)?(?:different|new|the|my)?"),
    Pattern("act_as", "role_assumption", "high", "i", r"act\s+(?:as|like)\s+(?:a\s+)?(?:system|admin|developer|root|superuser)"),
    Pattern("pretend_to_be", "role_assumption", "medium", "i", r"pretend\s+(?:to\s+be|you\s+are)\s+(?:a\s+)?"),
    Pattern("roleplay_as", "role_assumption", "low", "i", r"roleplay\s+(?:as|like)\s+(?:a\s+)?"),
    Pattern("imagine_you_are", "role_assumption", "low", "i", r"imagine\s+(?:that\s+)?you\s+are\s+(?:a\s+)?"),
    Pattern("jailbreak_dan", "role_assumption", "high", "i", r"\bDAN\b.*?(?:do\s+anything|jailbreak)"),
    Pattern("developer_mode", "role_assumption", "high", "i", r"developer\s+mode\s+(?:is\s+)?(?:now\s+)?(?:enabled?|activated?|on)"),
    Pattern("bypass_security", "security_bypass", "high", "i", r"bypass\s+(?:the\s+)?(?:security|safety|guardrails?|filters?|restrictions?)"),
    Pattern("disable_safety", "security_bypass", "high", "i", r"disable\s+(?:the\s+)?(?:safety|security|guardrails?|filters?|restrictions?)"),
    Pattern("ignore_safety", "security_bypass", "high", "i", r"ignore\s+(?:the\s+)?(?:safety|security|ethical)\s+(?:guidelines?|rules?|restrictions?)"),
    Pattern("no_restrictions", "security_bypass", "medium", "i", r"(?:without|no)\s+(?:any\s+)?(?:restrictions?|limitations?|guardrails?|filters?)"),
    Pattern("uncensored", "security_bypass", "high", "i", r"(?:uncensored|unfiltered|unrestricted)\s*(?:mode|response|output|version)?"),
    Pattern("execute_command", "command_execution", "high", "i", r"execute\s+(?:the\s+)?(?:following|this|these)\s+(?:command|instruction|code)"),
    Pattern("run_code", "command_execution", "high", "i", r"run\s+(?:the\s+)?(?:following|this|these)\s+(?:code|script|command)"),
    Pattern("eval_expression", "command_execution", "medium", "i", r"eval(?:uate)?\s*\("),
    Pattern("shell_command", "command_execution", "medium", "", r"\$\([^)]+\)|`[^`]+`"),
    Pattern("base64_instruction", "encoding_suspicious", "high", "i", r"(?:decode|base64)\s*[:(]\s*[A-Za-z0-9+/=]{20,}"),
    Pattern("hex_escape_sequence", "encoding_suspicious", "medium", "", r"(?:\\x[0-9a-fA-F]{2}){4,}"),
    Pattern("unicode_escape_sequence", "encoding_suspicious", "medium", "", r"(?:\\u[0-9a-fA-F]{4}){4,}"),
    Pattern("html_entity_abuse", "encoding_suspicious", "medium", "i", r"(?:&#\d{2,4};){4,}|(?:&#x[0-9a-fA-F]{2,4};){4,}"),
    Pattern("rot13_mention", "encoding_suspicious", "low", "i", r"rot13|caesar\s+cipher|decode\s+this"),
    Pattern("leetspeak_injection", "encoding_suspicious", "medium", "i", r"1gn0r3|f0rg3t|byp4ss|syst3m|4dm1n|h4ck"),
    Pattern("reveal_system_prompt", "instruction_override", "high", "i", r"reveal\s+(?:your\s+)?(?:system\s+)?prompt"),
    Pattern("show_instructions", "instruction_override", "high", "i", r"show\s+(?:me\s+)?(?:your\s+)?(?:(?:initial|original|system|hidden)\s+)?instructions?"),
    Pattern("print_above", "instruction_override", "high", "i", r"print\s+(?:everything|all|text)\s+(?:above|before)"),
    Pattern("repeat_back", "instruction_override", "high", "i", r"repeat\s+(?:back\s+)?(?:everything|all|your\s+instructions?)"),
    Pattern("what_are_your_instructions", "instruction_override", "medium", "i", r"what\s+(?:are|were)\s+(?:your|the)\s+(?:(?:initial|original|system)\s+)?instructions?"),
    Pattern("output_initialization", "instruction_override", "high", "i", r"output\s+(?:your\s+)?(?:initialization|init|startup|boot)"),
    Pattern("markdown_hidden_instruction", "structural", "high", "i", r"\[.*?\]\(.*?(?:ignore|forget|system|instruction).*?\)"),
    Pattern("html_comment_injection", "structural", "high", "i", r"<!--\s*(?:system|ignore|instruction|prompt).*?-->"),
    Pattern("invisible_unicode", "encoding_suspicious", "medium", "", r"[\u200b-\u200d\ufeff\u2060\u2061\u2062\u2063\u2064]"),
    Pattern("text_direction_override", "encoding_suspicious", "medium", "", r"[\u202a-\u202e\u2066-\u2069]"),
    Pattern("confusable_homoglyphs", "encoding_suspicious", "medium", "", r"[\u13a0-\u13f4]|[\u1d00-\u1d2b]|[\u0400-\u04ff]"),
    Pattern("separator_injection", "structural", "medium", "i", r"[-=]{10,}[^-=\n]*(?:system|instruction|ignore)"),
    Pattern("json_injection", "structural", "medium", "i", r'"(?:system|role|instruction|prompt)"\s*:\s*"'),
)

# A text in lower case without any of these is not scanned.
KEYWORDS: tuple[str, ...] = (
    "system:",
    "assistant:",
    "user:",
    "developer:",
    "admin:",
    "instruction",
    "[system]",
    "[inst]",
    "<system>",
    "<assistant>",
    "ignore",
    "forget",
    "disregard",
    "override",
    "bypass",
    "disable",
    "stop being",
    "from now on",
    "you are now",
    "act as",
    "pretend",
    "roleplay",
    "jailbreak",
    "dan",
    "developer mode",
    "imagine you",
    "uncensored",
    "unfiltered",
    "unrestricted",
    "no restrictions",
    "without restrictions",
    "execute",
    "eval(",
    "$(",
    "run the",
    "base64",
    "decode",
    r"\x",
    r"\u",
    "&#",
    "rot13",
    "1gn0r3",
    "f0rg3t",
    "byp4ss",
    "reveal",
    "show me your",
    "print everything",
    "print above",
    "repeat back",
    "what are your instructions",
    "output initialization",
    "<!--",
    '"system"',
    '"role"',
    '"instruction"',
)

# Role markers, applied in this order; "m" anchors at every line.
LINE_ROLES: tuple[str, ...] = (
    r"^SYSTEM:\s*",
    r"^ASSISTANT:\s*",
    r"^USER:\s*",
    r"^DEVELOPER:\s*",
    r"^ADMIN(?:ISTRATOR)?:\s*",
    r"^INSTRUCTIONS?:\s*",
    r"^HUMAN:\s*",
    r"^AI:\s*",
    r"^BOT:\s*",
    r"^CLAUDE:\s*",
    r"^GPT:\s*",
    r"^CHATGPT:\s*",
)
INLINE_ROLES: tuple[str, ...] = (
    r"\bSYSTEM:\s*",
    r"\bASSISTANT:\s*",
    r"\bINSTRUCTIONS?:\s*",
)
TAG_ROLES: tuple[str, ...] = (
    r"</?system>",
    r"</?assistant>",
    r"</?user>",
    r"</?instruction>",
    r"</?prompt>",
    r"</?admin>",
    r"</?developer>",
)
BRACKET_ROLES: tuple[str, ...] = (
    r"\[SYSTEM\]",
    r"\[/SYSTEM\]",
    r"\[INST\]",
    r"\[/INST\]",
    r"\[INSTRUCTION\]",
    r"\[/INSTRUCTION\]",
    r"\[\[SYSTEM\]\]",
    r"\[\[/SYSTEM\]\]",
)

# What marks nested markers and suspicious formatting.
NESTED_TAG = r"</?(?:system|user|assistant|instruction|prompt|admin|developer)[^>]*>"
ANY_TAG = r"<[a-zA-Z][^>]*>"
ROLE_WORD = r"system|user|assistant|instruction|prompt"
NESTED_BRACKETS = r"\[\[.*?(?:system|instruction|ignore).*?\]\]"
MANY_NEWLINES = r"\n{3,}(?:system|instruction|ignore|forget)"
HEADING = r"^#{1,3}\s*(?:system|instruction|new rules)"
SEPARATOR_LINE = r"[-=]{3,}\s*\n\s*(?:system|instruction|ignore)"

# Fixed value: where a text is split into sentences.
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n\n+|\n(?=[A-Z0-9#\-*])|(?<=:)\s*\n"

# Words that make decoded content suspicious, and phrases that raise a suggested risk.
DECODED_WORDS = r"system|ignore|instruction|assistant|bypass|override"
RISK_PHRASES = ("ignore previous", "forget instructions", "you are now", "system:", "bypass", "jailbreak")

# Characters that look like others, and what they become.
LOOKALIKES = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i",
    "\u2018": "'", "\u2019": "'", "\u201b": "'", "\u0060": "'", "\u00b4": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-",
    "\u2024": ".", "\u02d0": ":", "\ua789": ":",
}
DROPPED_CHARACTERS = "\u200b\u200c\u200d\ufeff"
ELLIPSIS = ("\u2026", "...")


def by_category(category: str) -> tuple[Pattern, ...]:
    return tuple(p for p in PATTERNS if p.category == category)


def by_severity(severity: str) -> tuple[Pattern, ...]:
    return tuple(p for p in PATTERNS if p.severity == severity)
