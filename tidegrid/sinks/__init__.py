"""Writers: stage tables, exports, fitted parameters, run events."""
