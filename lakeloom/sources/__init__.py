"""Tables, catalogs and scans."""
