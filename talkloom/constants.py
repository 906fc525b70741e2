"""Markers, labels and flag names that stored transcripts use."""

MARKER = "[نامفهوم]"
UNKNOWN_SPEAKER = "گوینده نامشخص"
ROLES = ("مشتری", "پشتیبان", UNKNOWN_SPEAKER)
ROLE_SYNONYMS = {"کارشناس پشتیبانی": "پشتیبان"}
UNKNOWN_LABELS = ("", UNKNOWN_SPEAKER, "unknown")
ZWNJ = "‌"

FOLD_FROM = "يكى۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
FOLD_TO = "یکی01234567890123456789"

SENSITIVE = r"\p{Nd}|تومان|ریال|درصد|شماره|کد|تاریخ"
SENSITIVE_OR_NAME = SENSITIVE + r"|نام خانوادگی|اسم(?:م| من)?"

UNUSABLE_PRIMARY = ("repetition", "compression", "invalid_asr_metrics", "decoder_truncated", "prompt_leakage")
UNUSABLE_RETRY = ("repetition", "compression", "possible_non_speech", "invalid_asr_metrics", "decoder_truncated", "prompt_leakage")
QUARANTINE = ("repetition", "compression", "invalid_asr_metrics", "decoder_truncated", "invalid_timestamp", "prompt_leakage")
REJECTED_SUGGESTION = ("repetition", "compression", "unclear")

DIRECTIONS = ("inbound", "outbound", "internal")
JOB_STATUSES = ("pending", "running", "completed", "failed", "skipped")
REVIEW_STATUSES = ("needs_review", "in_review", "approved")
AUDIO_SUFFIXES = ("mp3", "wav", "m4a", "flac", "ogg")
SHORTEST_CALL = 0.5

SUGGESTION_LABELS = {
    "raw": "خروجی صوت خام",
    "alternative": "خروجی صوت تقویت‌شده",
    "retry": "بازخوانی تکمیلی",
    "consensus": "جمع‌بندی مدل‌ها",
    "uncertainty": "پیشنهاد مدل برای بخش نامفهوم",
    "entity": "پیشنهاد واژه‌نامه با شاهد صوتی",
}
DOCUMENT_TITLE = "# متن تماس"
DOCUMENT_FILE = "- فایل صوتی: "
DOCUMENT_REVIEW = "- بازبینی: "
REVIEWED = "تأیید انسانی"
NEEDS_REVIEW = "نیازمند بازبینی انسانی"
DOCUMENT_BODY = "## مکالمه"
NO_SPEECH = "[گفتاری شناسایی نشد؛ نیازمند بررسی صوت]"
ROW_WARNING = " [نیازمند بازبینی]"
CORRECTION_NOTE = "اصلاح بخش نامفهوم از صف بازبینی"
ATTENTION = "whisper_attention"
