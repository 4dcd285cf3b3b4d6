"""Constants that define semantics; every operator takes them as defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1800
    chunk_overlap: int = 120
    dimension: int = 1024
    embed_batch: int = 64
    top_k: int = 5
    store_top_k: int = 4
    prompt_history: int = 12
    query_history: int = 8
    history_chars: int = 500
    title_chars: int = 80
    document_preview: int = 200
    context_preview: int = 500
    admins: tuple[str, ...] = ("admin",)


SETTINGS = Settings()

# Texts that answers, prompts and titles are compared with or built from.
NEW_CHAT = "New chat"
MANUAL_ENTRY = "Manual entry"
NO_CONTEXT = "No relevant context found."
REFUSAL = "I don't have enough information from the provided documents."
GREETING = "Hello! How can I help you today? You can ask me anything, and I'll do my best to help."
GREETING_PREVIEW = "Greeting handled without document retrieval."
SYSTEM_PROMPT = (
    "You are a retrieval-augmented AI assistant.\nYou MUST answer ONLY using the provided context.\n\nRULES:\n- Do NOT use outside knowledge\n"
    '- If answer is missing, say exactly:\n"I don\'t have enough information from the provided documents."\n- Be concise and factual\n'
)
FALLBACK_PROMPT = (
    "You are a helpful general-purpose AI assistant.\nAnswer the user's question using your general knowledge.\nBe clear, useful, and concise.\n"
    "If the question needs current or private information you do not have, say what you cannot verify and explain how the user can check it."
)
EXTENSIONS = ("pdf", "docx", "txt")
# Fixed value: the greetings, on text of letters and single spaces.
GREETING_PATTERN = r"^((hi|hello|hey|hii|hiya)( (there|bot|assistant))?|good (morning|afternoon|evening)|howdy|greetings)$"
