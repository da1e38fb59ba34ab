"""Where data comes from: canonical views of the tables, protocol files and file manifests."""
