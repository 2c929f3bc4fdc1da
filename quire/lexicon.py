"""Word lists, sets and limits that results depend on."""

# Block types and warnings.
SCORED_TYPES = ["title", "paragraph", "list_item", "caption", "footnote"]
REPORTED_TYPES = [*SCORED_TYPES, "unknown"]
SECTION_TYPES = ["title", "paragraph", "list_item"]
QUALITY_WARNINGS = ["low_translation_quality", "high_overlay_risk", "english_residual_detected", "low_semantic_consistency", "low_semantic_confidence"]
CRITICAL_WARNINGS = [
    "english_residual_detected", "paragraph_english_residual_needs_review", "table_cell_needs_review", "translation_failed",
    "masked_without_translation", "source_masked_translation_rejected", "overlay_text_truncated", "weak_table_grid",
]
REVIEW_WARNINGS = [
    "paragraph_english_residual_cleaned", "table_cell_english_residual_cleaned", "overlay_written_with_review", "high_overlay_risk",
    "low_semantic_consistency", "low_semantic_confidence", "probable_fragment", "table_detection_uncertain",
]
BLOCKING_ISSUES = ["translation_incomplete", "table_translation_incomplete", "failed_blocks_present", "batch_failed"]

# Words for scoring.
SCORING_ACRONYMS = ["AI", "PDF", "URL", "CEFR", "API", "OCR", "LLM"]
SEMANTIC_STOPWORDS = ["a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with"]
SCORING_RESIDUALS = [
    "the", "and", "or", "with", "from", "this", "that", "agreement", "service", "customer", "shall", "will", "must", "who", "what", "when",
    "where", "why", "how", "one", "it",
]
MINI_SPAN_WORDS = ["who", "what", "when", "one", "it", "fun", "if"]

# Words for translation checks.
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "one", "it"]
RESIDUAL_WORDS = ["who", "what", "when", "if", "one", "it", "from", "however", "learning", "issues"]
RESIDUAL_PHRASES = ["artificial intelligence technology", "technology startups", "however issues", "ai-powered"]
PROTECTED_ACRONYMS = ["AI", "API", "CEFR", "HTTP", "IA", "LLM", "OCR", "PDF", "URL"]
PARAGRAPH_KEYWORDS = [
    "although", "biodiversity", "climate", "coastal", "developing", "earth", "extreme", "global", "however", "human", "it", "many", "over",
    "rising", "scientists", "while",
]
CELL_PROTECTED = ["IA", "AI", "PDF", "URL", "CEFR"]
CELL_RESIDUALS = ["algorithmic", "benefit", "consumer", "data", "faster", "higher", "improved", "job", "personalized", "privacy", "reduced", "risk", "sales"]
CELL_FRENCH = [
    "accidents", "algorithme", "algorithmique", "amelioree", "ameliores", "biais", "confidentialite", "detection", "emplois", "format", "plus",
    "problemes", "propre", "rapide", "remplacement", "securite", "secteur", "systeme", "valeur",
]
CELL_ARTICLES = ["le", "la", "les", "de", "des"]
COMMON_ENGLISH = [
    "the", "and", "or", "of", "to", "in", "for", "with", "this", "that", "agreement", "service", "customer", "party", "parties", "shall",
    "will", "must", "may", "when", "what", "who",
]

# Extraction noise.
NOISE_PHRASES = ["ai-powered", "however issues", "technology startups", "learning", "who", "what", "when", "if", "one", "it", "from"]
SHORT_TERMS = ["ai", "pdf", "url", "cefr"]
VERBS = "is|are|was|were|be|being|been|has|have|had|can|will|would|should|could|may|might|do|does|did"
VERB_ENDINGS = "ed|ing|ize|ise|ates?|ifies?"

# Formats.
MOCK_PREFIX = "[FR MOCK] "
ROLE_CONFIDENCE = {
    "title": 0.78, "paragraph": 0.72, "list_item": 0.82, "footnote": 0.78, "caption": 0.76, "header": 0.76, "footer": 0.76, "image": 0.9, "unknown": 0.45,
}
NEUTRAL_SCORE = 0.75
EDGE_PUNCTUATION = ".,;:!?()[]{}\"'"
