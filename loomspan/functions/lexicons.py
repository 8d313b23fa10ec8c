"""Word lists and thresholds of the transcript, routing and redaction rules (fixed values)."""

NEGATION = ("no", "not", "never", "cannot", "cant", "won", "wont", "didn", "didnt", "isn", "isnt", "aren", "arent", "false", "reject", "rejected", "blocked", "failed", "cancelled", "canceled")
AFFIRMATION = ("yes", "true", "can", "will", "is", "are", "approved", "approve", "accepted", "accept", "passed", "pass", "complete", "completed", "ready")
STOP = ("a", "an", "and", "are", "as", "at", "be", "for", "from", "i", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "we", "with", "you")
ACTION_MARKERS = ("action", "assign", "decide", "decision", "follow up", "fix", "need to", "next step", "send", "ship", "should", "todo", "will")
QUESTION_STARTS = ("who ", "what ", "when ", "where ", "why ", "how ", "can ", "could ", "should ")
LOW_CONFIDENCE = 0.65
LONG_GAP_MS = 30_000
HIGH_NO_SPEECH = 0.6
LOW_LOGPROB = -1.0
HIGH_COMPRESSION = 2.4
DUPLICATE_OVERLAP, RELATED_OVERLAP = 0.8, 0.25
STRATEGIES = {"single_audio": "single_transcript", "duplicate_or_retake": "keep_separate_with_duplicate_warning", "related_or_follow_up": "merged_chronological_with_source_refs", "unrelated_or_low_overlap": "separate_sections_no_forced_narrative"}
SENSITIVE_KEYS = ("api_key", "apikey", "authorization", "cookie", "credential", "password", "secret", "token")
MAX_STRING = 512
SCANNER_KEYWORDS = ("scan", "twain", "wia", "scanner", "fujitsu", "ricoh", "canon", "hp", "xerox", "brother", "epson", "lexmark", "adobe scan", "camscanner", "genius scan", "office lens", "scanbot", "paperport", "abbyy", "omnipage", "readiris", "kofax")
DIGITAL_KEYWORDS = ("pdftex", "latex", "microsoft word", "google docs", "acrobat distiller", "adobe pdf library", "openoffice", "libreoffice", "indesign", "quartz pdfcontext", "itext", "pdfbox", "openpdf", "reportlab", "fpdf", "wkhtmltopdf", "dompdf", "tcpdf", "hpdf", "spire.pdf")
MODEL_PRICES = (("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01), ("gemini-2.0-flash", 0.000075, 0.0003), ("gemini-1.5-flash", 0.000075, 0.0003), ("gemini-1.5-pro", 0.00125, 0.005), ("claude-3-5-haiku", 0.0008, 0.004), ("claude-3-5-sonnet", 0.003, 0.015), ("claude-sonnet", 0.003, 0.015))
PROVIDER_PRICES = {"gemini": (0.000075, 0.0003), "openai": (0.0025, 0.01), "custom_openai": (0.0025, 0.01), "claude": (0.003, 0.015), "ollama": (0.0, 0.0), "azure": (0.0025, 0.01)}
DEFAULT_PRICE = (0.005, 0.015)
MERMAID_STARTS = ("graph ", "graph\n", "graph TD", "graph LR", "graph TB", "graph BT", "graph RL", "flowchart", "sequenceDiagram", "stateDiagram-v2", "stateDiagram", "classDiagram", "erDiagram", "gitGraph", "pie", "journey")
MERMAID_ARROWS = ("-->", "->>", "-->>", "->", "---", "-.-", "==>")
PROGRESS_STAGES = (("detecting bboxes", 12.0, 22.0), ("recognizing layout", 22.0, 30.0), ("running ocr error detection", 30.0, 33.0), ("recognizing text", 33.0, 80.0), ("recognizing tables", 80.0, 86.0), ("running page extraction", 86.0, 90.0), ("llm processors running", 90.0, 96.0), ("running", 90.0, 96.0))
TEXT_LABELS = ("Text", "ListItem", "Caption", "Code", "Footnote", "PageHeader", "PageFooter", "SectionHeader", "TableOfContents", "Form")
VLM_LABELS = ("Table", "Equation")
