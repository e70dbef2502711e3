"""Operations for building training corpora: tokenising, archives, secrets,
fingerprints, chat formats, deduplication, language ID, token totals and
decontamination.  Nothing outside this subpackage imports it."""
