"""Training-data operators: language ID, quality, language-model scores, exact
and near duplicates, repeated passages, decontamination, mixing, chat
rendering and sharding. Nothing outside this folder imports it."""
