"""Fixed values of the domain: patterns, word lists and prompt texts. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values, as published for the policy manuals this engine serves ---
SECTION_NARROW = r"\b((?:17|18|19|20|21|22|23|24|25|26|27|28|29|30|31|32|33|34|35|36|49|50|95)\d{3})\b"
SECTION_WIDE = r"\b((?:1[7-9]|2[0-9]|3[0-6]|4[9]|5[0-9]|6[0-9]|7[0-9]|8[0-9]|9[0-5])\d{3})\b"
SECTION_KEYWORDS = (
    "variance", "pension", "liability", "gross weekly", "calculation", "enforcement", "deduction", "regulation",
    "effective date", "shared care", "historic income", "current income",
)
STOP_WORDS = (
    "how", "are", "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "under", "regarding",
    "about", "what", "does", "have", "when", "explain", "applies", "treated",
)
#: If any of the words is asked for, these are asked for too.
SYNONYMS = (
    (("paying", "parent"), ("nrp",)),
    (("variance",), ("differ", "differs", "difference", "change", "changed")),
)
DEFAULT_TOPIC = "maintenance calculations and variations"
INSTRUCTIONS = (
    "What is the {authority} policy regarding: ",
    "Explain the {guide} rules for: ",
    "Detail the official {authority} guidelines on: ",
)
QUESTION_PROMPT = (
    "Given the following {department} policy context, write one clear, direct question that is answered by this text. Do not write multiple "
    "questions, write only one. Keep it professional.\n\nContext: ", "\n\nQuestion:",
)
FALLBACK_QUESTION = "What is the {department} policy regarding the section: "
DEFAULT_SYSTEM = "You are a helpful AI assistant named SmolLM, trained by Hugging Face"
READER_SYSTEM = (
    "You are an expert Decision Maker helper for the {authority}. Answer the user's question accurately and professionally using ONLY the provided "
    "official policy contexts. State exact rules, percentages, and paragraph numbers if they are present in the context. If the context does not "
    "contain the information needed to answer the question, state clearly that the policy manual does not provide sufficient details. Do not assume "
    "or extrapolate."
)
CITATION = r"(?i)(Paragraph\s+\d+[a-zA-Z]?|Para\s+\d+|Chapter\s+\d+|Table\s+\d+)"
FIGURE = r"(?i)(\b\d+(?:\.\d+)?%\b|\b\d+\s*percent\b|£\d+(?:,\d+)*(?:\.\d+)?)"
BASE_OUTPUT = "--- BASE MODEL OUTPUT (UNTRAINED) ---"
TUNED_OUTPUT = "--- {authority} TUNED MODEL OUTPUT (LORA) ---"
NO_RESPONSE = "No response generated."
NOT_AVAILABLE = "N/A"
NO_ADAPTER = " [Fallback: LoRA weights not loaded]"
# --- end of fixed values ---


@dataclass(frozen=True)
class Names:
    """Whose manuals these are; filled into the prompts."""

    department: str = "department"
    authority: str = "policy authority"
    guide: str = "decision makers' guide"

    def fill(self, text: str) -> str:
        return text.format(department=self.department, authority=self.authority, guide=self.guide)
