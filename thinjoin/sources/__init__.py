"""Text scans, stored samples and statistics, synthetic tables."""
