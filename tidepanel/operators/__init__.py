"""DataFrame to DataFrame operators over hourly panels."""
