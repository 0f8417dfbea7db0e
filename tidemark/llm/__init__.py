"""Training-data operators: decontamination, URL lists, toxicity, tokenizing, language models, PII, search, licences, joins."""
