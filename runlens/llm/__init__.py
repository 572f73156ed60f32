"""Training-data operators: language id, sharding, token counts, subword encoding,
secret and personal-data scans, near-duplicate joins, chat formatting, benchmark
decontamination, quality rules, periodic runs, embedding whitening and SimHash links.  Nothing else in the library imports this package."""
