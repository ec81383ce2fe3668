"""Training-data operators: near duplicates, tokenisation, language, chat, toxicity, search and sharding."""
