"""Where findings go: JSON messages, a text report, SARIF and OpenVEX documents."""
