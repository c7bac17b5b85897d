"""Training-data operators: language id, media columns, packing, URL filters, decontamination,
toxicity, licence scans, chat formatting, PII, SimHash near-duplicates, importance resampling, byte-level BPE and alignment of tokenizers.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries.
"""
