"""Writers: patches, reports, prompts and saved plans."""
