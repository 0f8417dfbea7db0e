"""Tables in and out: scans, strict parsing, publishing, verification."""
