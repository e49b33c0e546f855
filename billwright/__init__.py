"""Invoice and receipt records from tables of texts, OCR words and token labels."""
