"""Fixed values.

Everything in this module has to be equal, character for character, in every
implementation of the same archive format; nothing here is logic.
"""

# --- fixed values: rendering of messages and chunks --------------------------------
DATE_FORMAT = "yyyy-MM-dd HH:mm"
LINE_FORMAT = "[date: {date}] [user: {sender}] {content}"
HEADER_FORMAT = "snippet: {start}–{end}. participants: {participants}.\n"
CONTINUATION = "\n[продолжение следует]"
UNKNOWN_SENDER = "Unknown"
UNKNOWN_CHAT = "unknown_chat"
DUMP_NAME_PATTERN = r"telegram_dump_(-?\d+)"
DUMP_NAME_PREFIX = "telegram_dump_"

# --- fixed values: message parts and permalinks -------------------------------------
MAX_PART_CHARS = 4096
PUBLIC_LINK = "https://t.me/{username}/{msg_id}"
CHANNEL_LINK = "https://t.me/c/{internal}/{msg_id}"
GROUP_LINK = "tg://openmessage?chat_id={chat_id}&message_id={msg_id}"
USER_LINK = "tg://openmessage?user_id={chat_id}&message_id={msg_id}"

# --- fixed values: retrieval --------------------------------------------------------
TOPIC_L1_SCORE = 0.8
TOPIC_L2_SCORE = 0.75
TOPIC_L1_WIDTH = 2
TOPIC_L2_WIDTH = 1
TOPIC_MIN_SIMILARITY = 0.5
TOPIC_CHUNKS = 3
FIND_WIDTH = 100

# --- fixed values: commands ---------------------------------------------------------
FIND_COMMAND = "/find"
SEARCH_WORDS = ("поиск", "find")
PUBLIC_COMMANDS = ("/admin_set", "/set_admin")

# --- fixed values: topic titles -----------------------------------------------------
UNNAMED_TITLE = "unknown"
L1_PLACEHOLDER = "Topic L1-"
L2_PLACEHOLDER = "Topic L2-"
PENDING_DESCRIPTION = "Pending description..."
FAILED_DESCRIPTION = "Failed to generate description after retries."
MAX_L1_PER_L2 = 5
MAX_CHUNKS_PER_L1 = 5
MAX_CHUNKS_PER_L2 = 25
MAX_CHUNK_CHARS = 4096
MIN_CHUNK_CHARS = 30

# --- fixed values: prompts ----------------------------------------------------------
EMPTY_CONTEXT = "Нет релевантного контекста."
EMPTY_HISTORY = "Нет недавних сообщений."
PROMPT_TEMPLATE = """
You are a librarian assistant. Be short, precise, and consistent.

context = retrieved RAG chunks selected for relevance
history = last chat messages showing the current situation

Your rules:
- Always start with a brief summary of context, then react to history.
- Use only plain text, ASCII only.
- No tables, no markup, no formatting blocks.
- Prefer factual compression: extract meaning, avoid long quotes.
- If context contradicts history, history has priority.
- If context is too large or repetitive, summarize it in 1 to 3 short lines.
- When answering, rely on RAG context whenever it improves accuracy.
- If context is missing or irrelevant, answer based on history alone.
- Keep answers minimal unless explicitly asked for details.

Task:
{task}

Context:
{context}

History:
{history}
"""
