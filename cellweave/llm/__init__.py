"""Training-data operators: chat, near duplicates, packing, language, quality, lines, tokens, media, URLs."""
