"""Text patterns in the Java dialect of Spark."""

from __future__ import annotations

# The patterns of the message normalization.
URL = r"(?i)https?://\S+|www\.\S+"
MENTION = r"(?<![\p{L}\p{N}_])@[A-Za-z0-9_]{1,30}"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<![\p{L}\p{N}_])(?:\+?[0-9][0-9 .()\-]{7,}[0-9])(?![\p{L}\p{N}_])"
PAYMENT = r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])"
ORDER = r"(?i)\b(?:order\s*(?:id|#|number)?\s*[:#-]?\s*[A-Z0-9-]{8,24}|[0-9]{3}-[0-9]{7}-[0-9]{7})\b"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
MASKS = [(EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (PAYMENT, "[PAYMENT_NUMBER]"), (ORDER, "[POSSIBLE_ORDER_ID]")]

#: White space as Python sees it: Java's Unicode class plus the four information separators.
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"
